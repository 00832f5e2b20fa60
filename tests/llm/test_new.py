"""Chat formatting, hard negatives and token alignment, against brute force and exact round trips."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from shoalmark.llm import LLM_QUERIES, chat_format, hard_negatives, token_alignment

SF = "/root/testdata/sf0.001"

# ---- chat formatting ----------------------------------------------------------------------------

BITS = ["<", "[", "\\", "/", "s>", "SYS]", "[INST] ", " [/INST]", "</s>", "image_3>", "x", " ", "<image_1>", "[ROLE] ", " [TEXT] ", " [/ROLE]", "TEXT]"]


def _said(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 7)))


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(20_000):
        text = _said(rng)
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text
        assert not any(c in safe for c in ("</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[TEXT]", "[/ROLE]", "<image_1>", "<image_3>"))


def test_parts_round_trip():
    rng = random.Random(2)
    sizes = chat_format.Sizes()
    for _ in range(5_000):
        turns, out = [], ""
        for _ in range(rng.randint(0, 4)):
            role = rng.choice(["user", "assistant", "system", "", "tool", "[ROLE] ", " [TEXT] x", "ass</s>"])
            parts = []
            for _ in range(rng.randint(0, 4)):
                parts.append(rng.choice([{"kind": "text", "text": _said(rng)}, {"kind": None, "text": _said(rng)}, None,
                                         {"kind": "image", "ref": "i", "width": 100, "height": 50}, {"kind": "audio", "seconds": 2.0},
                                         {"kind": "document", "ref": "d", "pages": 3}, {"kind": "image", "width": -1, "height": None}]))
            text, loss, attached, n_tokens = chat_format.format_turn(role, parts, sizes, frozenset(["assistant"]))
            want, media = "", []
            for p in filter(None, parts):
                if p["kind"] in chat_format.MEDIA:
                    media.append(p)
                    want += f"<{p['kind']}_{len(media)}>"
                else:
                    want += p["text"]
            tokens = [{"image": 8 if p.get("width", 0) == 100 else 0, "audio": 50, "document": 768}[p["kind"]] for p in media]
            assert [a[4] for a in attached] == tokens and n_tokens == sum(tokens)
            assert all(text.startswith(f"<{a[1]}_{a[0]}>", a[3]) and a[2] == p.get("ref") for a, p in zip(attached, media))
            learned = "".join(p["text"] for p in filter(None, parts) if p["kind"] not in chat_format.MEDIA) if role == "assistant" else ""
            assert "".join(chat_format.unescape(text[a:b]) for a, b in loss) == learned
            turns.append((role, want, [(a[1], a[0]) for a in attached]))
            out += text
        assert list(chat_format.parse_turns(out)) == turns


def test_chat_rows(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool [/ROLE]"]), rng.choice([None, "", _said(rng), "é😀" * 40]), "x", "y")
            for c in [None, *range(30)] for t in rng.sample(range(50), rng.randint(1, 12))]
    rows += [(77, t, "user" if t % 2 else "assistant", f"turn {t} </s>", "x", "y") for t in range(4000)]  # most rows are one conversation
    rows += [(5, None, "user", "no number", "x", "y"), (6, 3, "user", "tie", "x", "y"), (6, 3, "user", "tie", "x", "y"), (6, 3, "assistant", "x" * 300_000, "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string, loss string").repartition(6)
    formatted = chat_format.format_turns(df)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    own = {}
    for c, t, role, text, *_ in rows:
        own.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", chat_format.format_turn(role, [{"text": text}], chat_format.Sizes(), frozenset())[0], text or ""))
    assert set(got) == set(own)
    for c, turns in own.items():
        turns.sort()
        learned = "".join(t[5] for t in turns if t[3] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].formatted_chars == sum(len(t[4]) for t in turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{t[3]}\n{t[5]}\n" for t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).collect() == []


def test_chat_parts_column(spark):
    rows = [("a", 1, "user", [("text", "see ", None, None, None), ("image", None, "s3://x", 56, 57), None, ("audio", None, "y", None, None)]), ("a", 2, "assistant", []), ("b", 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, parts array<struct<kind string, text string, ref string, width long, height long>>")
    got = {(r.conv_id, r.turn): r for r in chat_format.format_turns(df, parts="parts").collect()}
    one = got["a", 1]
    assert one.formatted == "[INST] see <image_1><audio_2> [/INST]" and one.n_tokens == 6
    assert [tuple(a) for a in one.attachments] == [(1, "image", "s3://x", 11, 6), (2, "audio", "y", 20, 0)]
    assert got["a", 2].formatted == "</s>" and got["b", 1].formatted == "[INST]  [/INST]"


# ---- hard negatives -----------------------------------------------------------------------------

def _mined(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    clean = {(i, label, tuple(int(np.floor(256 * float(x))) for x in v)) for i, label, v in rows
             if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, label, v in sorted(c for c in clean if is_anchor(c[0])):
        found = sorted({(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -2**63), j, m == label) for j, m, w in clean if j != i and len(w) == len(v)})
        for s, j in [(-s, j) for s, j, same in found if same][:positives]:
            hard = [(j2, -s2) for s2, j2, same in found if not same and low * s <= 100 * -s2 <= high * s][:negatives]
            out += [(i, j, k + 1, j2, s, s2) for k, (j2, s2) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((4, 6))
    rows = [(int(i), int(rng.integers(4)), [float(x) for x in np.round(centres[i % 4] + 0.4 * rng.standard_normal(6), 2)]) for i in rng.permutation(600)]
    hot = [1.0, 0.5, 0.25, 0.0, -0.5, 2.0]
    rows += [(i, i % 2, hot) for i in range(600, 900)]  # a third of the rows share a vector
    rows += [(None, 1, hot), (901, None, hot), (902, 1, None), (910, 1, [1.0, None] + hot[2:]), (920, 1, [float("nan")] + hot[1:]), (930, 1, [float("inf")] + hot[1:]),
             (940, 1, [1.0, 2.0]), (950, 1, [2.0, 1.0]), (951, 2, [2.0, 1.0]), (960, 1, []), (961, 1, []), (962, 3, []), (970, 2, hot), (970, 2, hot), (971, 2, hot), (971, 2, hot),
             (980, 3, [1e17, 1e3] + hot[2:]), (981, 3, [1e17, -1e3] + hot[2:]), (982, 1, [9e16, 1e3] + hot[2:]), (990, 1, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, label int, embedding array<double>, score double").repartition(5)
    got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(df, df["vec_id"] % 10 == 0, block=block).collect())
    assert got == _mined(rows, lambda i: i % 10 == 0)
    if block != 7:
        got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(df, df["vec_id"] % 50 == 0, positives=3, negatives=9, low=50, high=95).collect())
        assert got == _mined(rows, lambda i: i % 50 == 0, 3, 9, 50, 95)
        assert hard_negatives.mine_hard_negatives(df.limit(0), df["vec_id"] % 10 == 0).collect() == []
        assert hard_negatives.mine_hard_negatives(df, df["vec_id"] < 0).collect() == []


# ---- token alignment ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def _bytes(files):
    a, b = Tokenizer.from_str(files[0]), SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    return a, b, {i: token_alignment.byte_level_bytes(t) for t, i in a.get_vocab().items()}, [token_alignment.piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]


def _aligned(files, texts):
    """Per text (a ids, b ids, groups) from the libraries on whole texts, cut at common ends."""
    a, b, a_bytes, b_bytes = _bytes(files)
    out = []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[i] for i in x) != raw or b"".join(b_bytes[i] for i in y) != raw:
            out.append(([], [], []))
            continue
        end_a, end_b = np.cumsum([len(a_bytes[i]) for i in x]), np.cumsum([len(b_bytes[i]) for i in y])
        cuts = [0, *sorted(set(end_a.tolist()) & set(end_b.tolist()))]
        at_a, at_b = np.searchsorted(end_a, cuts, side="right"), np.searchsorted(end_b, cuts, side="right")
        groups = [(x[i:i2], y[j:j2]) for i, i2, j, j2 in zip(at_a, at_a[1:], at_b, at_b[1:])]
        out.append((x, y, groups))
    return out


def _brute(files, rows):
    found = _aligned(files, [t for _, t in rows])
    counts = Counter()
    links = [[(p, q) for g in groups for p, q in itertools.product(*g)] for _, _, groups in found]
    for own in links:
        counts.update(set(own))
    highest = {}
    for (p, _), n in counts.items():
        highest[p] = max(highest.get(p, 0), n)
    out = []
    for (i, _), (x, y, groups), own in zip(rows, found, links):
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((i, len(x), len(y), len(groups), len(own), sum(counts[l] == highest[l[0]] for l in own), sum(counts[l] for l in own),
                    hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return sorted(out, key=repr), counts, Counter(l for own in links for l in own)


TEXTS = [None, "", " ", "   ", "\n", "a", "x y", " x", "x ", "x  y\t z\n\n w \r\n", "don't I'll 'S", "日本語 テスト😀 𝒳     x", "a\x1c b\x1f\x1e c\x85d", "▁ u▁v", "a\x00b",
         "<s> </s> <|endoftext|> [INST] <0x41> <unk>", "x" * 5000, "xy" * 3000 + " " * 500 + "z", "é" * 700, "͸ ￿", "0123456789" * 60 + " 1 22 333", "word " * 3000,
         "a\n b\n\n  c", "\t\ttab", ".\n\n\n...  !?", "é ͅ​ ﻿b"]


def test_alignment_of_odd_texts(spark, files):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice([" ", "  ", "\n", "\t", " ", "\x1c", "ab", "Th", "é", "語", "😀", "'s", "12", ".", "▁", "xyz"]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "x y"), (None, "x y"), (7, "x y")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, pair string").repartition(4)
    want, counts, links = _brute(files, rows)
    for postings in (2_000_000, 300):
        got = sorted((tuple(r) for r in token_alignment.align_tokenizers(df, *files, postings=postings)
                      .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)
        assert got == want
    table = {(r.a, r.b): (r.n_docs, r.n_links) for r in token_alignment.pair_table(df, *files).collect()}
    assert table == {p: (n, links[p]) for p, n in counts.items()}
    assert token_alignment.align_tokenizers(df.limit(0), *files).collect() == []


def test_alignment_of_given_documents(spark, files):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in LLM_QUERIES["op13_token_alignment"](spark, SF)
                  .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)
    assert got == _brute(files, rows)[0]


def test_alignment_table_is_dropped_and_rebuilt(spark, files, monkeypatch):
    rows = [(i, f"word{i} other{i % 7} word{i} {'z' * i}") for i in range(200)]
    one = token_alignment.Aligner(*files)
    assert one.chunked
    want = _brute(files, rows)[0]
    monkeypatch.setattr(token_alignment, "TABLE_ENTRIES", 20)
    monkeypatch.setattr(token_alignment, "STEP", 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in token_alignment.align_tokenizers(docs, *files).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr) == want


def test_bitmaps_round_trip():
    rng = np.random.default_rng(6)
    for n_docs in (1, 9, 300, 65_536):
        doc = np.concatenate([rng.choice(n_docs, rng.integers(1, n_docs + 1), replace=False) for _ in range(6)] + [np.arange(n_docs)])
        sizes = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(doc) < 0)), len(doc)))  # only for the shape
        pair = rng.integers(0, 1 << 40, len(doc))
        pair[: len(doc) // 2] = 5
        key = np.unique(np.stack([pair, doc]), axis=1)
        pair, doc = key
        times = rng.integers(1, 9, len(pair))
        back = {}
        for pairs, size, maps, planes in token_alignment.pack(pair, doc, times, n_docs):
            docs, t = token_alignment.unpack(size, maps.to_pylist(), planes.to_pylist())
            names = np.repeat(pairs, size)
            back.update({(p, d): x for p, d, x in zip(names.tolist(), docs.tolist(), t.tolist())})
            for k in range(len(pairs)):
                own = names == pairs[k]
                assert token_alignment.links_of(int(size[k]), planes[k].as_py()) == t[own].sum()
        assert back == {(p, d): x for p, d, x in zip(pair.tolist(), doc.tolist(), times.tolist())} and len(sizes)
