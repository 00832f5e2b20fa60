"""Values fixed by the published analysis; results depend on them being exactly these."""

# Spelling repairs applied to survey names.
NAME_FIXES = {
    "Urophycis earlli": "Urophycis earllii",
    "Aluterus heudeloti": "Aluterus heudelotii",
}
FIRST_WORD_FIXES = {"Paralepidae": "Paralepididae"}

# Catch labels that are not identified fish.
REMOVED_LABELS = [
    "Unknown 04",
    "Unknown 05",
    "Unknown 06",
    "Unidentified fish",
    "No fish but good tow",
    "Chlamys islandica clapper",
    "Placopecten magellanicus clapper",
    "Loligo pealeii",
    "Loligo pleii",
    "Geryon quinquedens",
    "Geryon fenneri",
]

# Level codes that count as an estimate at species level.
SPECIES_LEVELS_STRICT = ["spe"]
SPECIES_LEVELS = ["spe-ocean", "spe", "spe-FAO", "spe-LME"]

# Day-of-year window of the survey seasons (a year cut in four parts of 91.5 days).
SPRING_START_DAY = 91.5
SPRING_END_DAY = 183.0
FALL_START_DAY = 274.5

# Decade labels; the first and last bins are open ended.
DECADES = [
    (1980, "1970-1979"),
    (1990, "1980-1989"),
    (2000, "1990-1999"),
    (2010, "2000-2009"),
]
LAST_DECADE = "2010-2019"

# Padding of the map extent: west, south, east, north.
EXTENT_PAD = (-1.0, -2.0, 1.0, 0.5)

# Normal quantile of the 95 % interval as the analysis writes it.
Z95 = 1.96

# Prediction cells are 10 km wide, so 100 square km.
CELL_KM = 10.0
CELL_AREA = 100.0
