"""Closed vocabularies of the record model."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polymer family -> its names and abbreviations.
POLYMER_NAMES = {
    "polystyrene": ["ps", "polystyrene"],
    "poly(methyl methacrylate)": ["pmma", "poly(methyl methacrylate)", "polymethylmethacrylate", "polymethyl methacrylate"],
    "poly(n-butyl methacrylate)": ["pnbma", "poly(n-butyl methacrylate)"],
    "polyethylene": ["pe", "polyethylene"],
    "polypropylene": ["pp", "polypropylene", "it-pp", "itpp", "isotactic polypropylene"],
    "poly(ethylene glycol)": ["peg", "peo", "poly(ethylene glycol)", "poly(ethylene oxide)", "polyethylene glycol", "polyethylene oxide", "eo", "ethylene oxide"],
    "poly(propylene glycol)": ["ppo", "ppg", "poly(propylene glycol)", "poly(propylene oxide)", "polypropylene glycol", "polypropylene oxide", "propylene oxide", "po"],
    "poly(butene oxide)": ["pbo", "poly(butene oxide)", "bo", "butene oxide"],
    "poly(hexene oxide)": ["pho", "poly(hexene oxide)", "ho", "hexene oxide"],
    "polyisobutylene": ["pib", "polyisobutylene"],
    "poly(lactic acid)": ["pla", "plla", "poly(lactic acid)", "poly(l-lactic acid)", "poly(l-lactide)", "poly(lactide)", "polylactide"],
    "polyisoprene": ["pi", "polyisoprene", "1,4-pi", "polyisoprene (1,4-pi)", "polyisoprene (1,4-isoprene)"],
    "poly(caprolactone)": ["pcl", "poly(caprolactone)", "polycaprolactone"],
    "poly(dimethylsiloxane)": ["pdms", "poly(dimethylsiloxane)", "polydimethylsiloxane"],
    "poly(butyl acrylate)": ["pba", "poly(butyl acrylate)"],
    "poly(butylene succinate)": ["pbs", "poly(butylene succinate)"],
    "poly(vinyl acetate)": ["pvac", "poly(vinyl acetate)"],
    "poly(vinylpyrrolidone)": ["pvp", "poly(vinylpyrrolidone)"],
    "poly(n-isopropylacrylamide)": ["pnipam", "poly(n-isopropylacrylamide)", "poly(nipam)"],
    "poly(vinyl chloride)": ["pvc", "poly(vinyl chloride)"],
    "poly(acrylic acid)": ["paa", "poly(acrylic acid)"],
    "poly(methacrylic acid)": ["pmaa", "poly(methacrylic acid)"],
    "poly(ethylene terephthalate)": ["pet", "poly(ethylene terephthalate)"],
    "poly(tert-butyl acrylate)": ["ptba", "poly(tert-butyl acrylate)"],
    "poly(hydroxyalkanoate)": ["pha", "poly(hydroxyalkanoate)"],
    "poly(3-hydroxybutyrate)": ["phb", "poly(3-hydroxybutyrate)"],
    "polyamide": ["pa", "polyamide"],
}
# Solvent -> its names.
SOLVENT_NAMES = {
    "1,2-dichlorobenzene": ["odcb", "ortho-dichlorobenzene", "1,2-dichlorobenzene"],
    "1,2,4-trichlorobenzene": ["tcb", "1,2,4-trichlorobenzene"],
    "acetonitrile": ["acn", "acetonitrile", "ch3cn"],
    "tetrahydrofuran": ["thf", "tetrahydrofuran"],
    "butanone": ["mek", "methyl ethyl ketone", "butanone"],
    "dimethylformamide": ["dmf", "dimethylformamide", "n,n-dimethylformamide"],
    "isopropyl alcohol": ["ipa", "isopropyl alcohol", "isopropanol", "2-propanol"],
    "dichloromethane": ["dcm", "dichloromethane", "ch2cl2"],
}
# Further solvent names that only the per-extractor deduplication knows.
MORE_SOLVENTS = {"water": ["h2o"], "methanol": ["meoh"], "ethanol": ["etoh"], "isopropyl alcohol": ["ipa", "isopropanol", "2-propanol", "isopropyl alcohol"]}
# Architecture as written -> as exported.
ARCHITECTURES = {
    "linear": "linear", "linear homopolymer": "linear", "homopolymer": "linear", "linear homopolymer with various end groups": "linear",
    "ring": "cyclic", "cyclic": "cyclic", "star": "star", "2-arm": "star", "graft": "graft",
    "diblock": "diblock", "ab block copolymer": "diblock", "diblock (ab)": "diblock", "eo–po diblock": "diblock", "eo-po diblock": "diblock",
    "triblock": "triblock", "triblock copolymer": "triblock", "triblock (eo-po-eo)": "triblock", "bab block copolymer": "triblock", "triblock (bab)": "triblock",
    "block copolymer": "block copolymer", "block": "block copolymer", "ab block": "block copolymer", "tetrablock copolymer": "tetrablock", "tetrablock": "tetrablock",
    "random copolymer": "random copolymer", "null": None, "none": None, "difunktionell": None, "monomethyl ether": None,
}
# Spellings of the two ratio bases; the first set is asked first.
BY_VOLUME = ("v/v", "vol%", "vol.%", "vol-%", "%v/v", "%", "v%", "v:v", "v/v%", "v/v/v", "%byvolume")
BY_WEIGHT = ("wt%", "wt-%", "wt.%", "w/w", "%w/w", "wt.-%", "vol-%", "vol.-%")
# Column modes.
COLUMN_MODES = {
    "Reversed Phase": ("reverse phase", "reversed phase"), "Normal Phase": ("normal phase",),
    "HILIC": ("hilic", "hydrophilic interaction", "hydrophilic interaction chromatography"),
    "SEC": ("sec", "size exclusion", "size exclusion chromatography"),
}
# Patterns and word lists of the matchers.
ARCH_PREFIX = r"^(ring|cyclic|linear|star|comb|ls|lu|it|at|st|dendri|hyper|branched)[_\-\s]+"
MW_TOKEN = r"(?:\b|(?<=[a-zA-Z\-_]))(\d{2,}[kKmMgG]?|\d+[kKmMgG]+)\b"
FUNCTIONAL = r"\b(diol|diene|diallyl|monool|dichloride|diolefin|diamine|dicarboxyl|hydroxyl|amine|acid|acrylate|methacrylate)\b"
BENIGN = r"^(homopolymer|standard|calibrant|backbone|chain|grade|sample|type\s+[a-z0-9])?$"
COMPONENT_SUFFIX = r"\s+(block|repeat\s*unit|repeating\s*unit|unit|segment|chain|backbone)$"
COMPONENT_SUFFIX_WIDE = r"\s+(block|repeat(?:ing)?\s*units?|units?|segments?|chains?|backbone|moiety|moieties)$"
COLUMN_STOPWORDS = ("column", "columns", "of", "the", "a", "an", "and", "with", "x", "by", "two", "three", "four", "five", "rp", "np", "hplc", "lc", "phase")
END_GROUP = r"with\s+([\w-]+)\s+end[\s-]*groups?|(\w[\w-]*)[-\s]terminated\b"
BLOCK_COUNT = r"\b(di|tri|tetra|penta|multi)[\s-]*block\b"
BLOCK_CONNECTORS = ("b", "block", "co", "stat", "ran", "alt", "g", "graft")


def _key(s: str) -> str:
    return "".join(c for c in s if c in "abcdefghijklmnopqrstuvwxyz0123456789")


#: Letters and digits of a name -> family; one lookup replaces a search over all names.
POLYMERS = {_key(n): family for family, names in POLYMER_NAMES.items() for n in names}
SOLVENTS = {_key(n): family for family, names in SOLVENT_NAMES.items() for n in names}
SOLVENTS_EXTENDED = SOLVENTS | {_key(n): family for family, names in MORE_SOLVENTS.items() for n in names}


def lookup(table: dict[str, str | None], key: Column) -> Column:
    """Value of a literal map, null where the key is unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def sql_map(table: dict[str, str | None]) -> str:
    """The same map as SQL text for the oracle."""
    q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"
