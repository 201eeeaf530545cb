"""Values fixed by the analysis itself; every operator takes them as defaults."""

# --- fixed values: publisher boilerplate words -------------------------------
PUBLISHER_WORDS = (
    "wiley", "elsevier", "john", "springer", "blackwell", "ltd", "authors",
    "author", "taylor", "francis", "copyright", "press", "mdpi", "licensee",
    "basel", "switzerland", "sons",
)
# the combined corpus drops one word more
PUBLISHER_WORDS_COMBINED = PUBLISHER_WORDS + ("australia",)

# --- fixed values: abstract cleaning, applied in this order ------------------
# (text a match must hold, pattern). (?s) lets "." run over line ends, so a
# notice is cut to the end of the text.
CLEAN_RULES = (
    ("©", r"(?s)©.*"),
    ("Copyright", r"(?s)(Crown Copyright|Copyright).*"),
    ("(C) ", r"(?s)\(C\) [0-9].*"),
    ("(c) ", r"(?s)\(c\) [0-9].*"),
    ("[No abstract available]", r"\[No abstract available\]"),
    ("from Authors", r"from Authors"),
)

# --- fixed values: document-frequency bounds per corpus (min, max) -----------
DF_BOUNDS = {
    "reviewed": (8, 203),
    "combined": (6, 300),
    "full": (8, 400),
}

# --- fixed values: collocation cut-offs and trend classes --------------------
BIGRAM_T = 1.6
TRIGRAM_T = 1.4
HOT_ABOVE = 0.1
COLD_BELOW = -0.1
LAST_FULL_YEAR = 2021

# --- fixed values: period schemes, (last year of the period, label) ----------
PERIOD_SCHEMES = {
    "a": (
        (1975, "1966-1975"), (1980, "1976-1980"), (1985, "1981-1985"),
        (1990, "1986-1990"), (1995, "1991-1995"), (2000, "1996-2000"),
        (2005, "2001-2005"), (2010, "2006-2010"), (2015, "2011-2015"),
        (2021, "2016-2021"),
    ),
    "b": (
        (1976, "1966-1976"), (1981, "1977-1981"), (1986, "1982-1986"),
        (1991, "1987-1991"), (1996, "1992-1996"), (2001, "1997-2001"),
        (2006, "2002-2006"), (2011, "2007-2011"), (2016, "2012-2016"),
        (2021, "2017-2021"),
    ),
    "c": (
        (1994, "1981-1994"), (1999, "1995-1999"), (2004, "2000-2004"),
        (2009, "2005-2009"), (2014, "2010-2014"), (2019, "2015-2019"),
    ),
}
# scheme "d": one opening period, then single years
OPENING_PERIOD_D = (1994, "1981-1994")

# --- fixed values: expert labels of the reviewed corpus, in topic order ------
EXPERT_LABELS = ("Invertebrate", "Biogeochemistry", "Fish", "Assessment")

# --- fixed values: usual priors of a sampled topic model ---------------------
ALPHA_TOTAL = 50.0  # alpha = 50 / k
DELTA = 0.1
