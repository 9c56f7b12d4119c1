"""Scalar text functions as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def norm_id(x: Column) -> Column:
    """upper case, only A-Z and digits."""
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def norm_name(x: Column) -> Column:
    """lower case, only a-z and digits."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def slug(x: Column) -> Column:
    """runs of other characters become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def block(key: Column) -> Column:
    """what stands before the first hyphen; null if nothing does."""
    return F.nullif(F.split_part(key, F.lit("-"), F.lit(1)), F.lit(""))


def clean_name(x: Column) -> Column:
    """without parentheses and their content, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\([^)]*\)", " "), r"\s+", " "))


def candidates(name: Column, synonyms: Column, separator: str = ",") -> Column:
    """names to try in order: the name, its clean form, each synonym, its clean form; the first of those that are
    equal but for case stays.  Array of strings."""
    parts = F.transform(F.split(F.coalesce(synonyms, F.lit("")), separator), lambda s: F.trim(s))
    both = F.concat(F.array(F.trim(name), clean_name(name)), F.flatten(F.transform(parts, lambda s: F.array(s, clean_name(s)))))
    tried = F.filter(both, lambda s: s.isNotNull() & (s != ""))
    low = F.transform(tried, lambda s: F.lower(s))
    return F.filter(F.transform(tried, lambda s, i: F.when(F.array_position(low, F.lower(s)) == i + 1, s)), lambda s: s.isNotNull())


def first_token(x: Column, separator: str = ".") -> Column:
    """what stands before the first separator, as in a version suffix."""
    return F.split_part(x, F.lit(separator), F.lit(1))


def clean_target(x: Column, limit: int = 3) -> Column:
    """separators unified, blanks dropped, cut to the first ``limit``, then made distinct; null if nothing is left."""
    parts = F.filter(F.transform(F.split(F.translate(x, ";", ","), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.nullif(F.array_join(F.array_distinct(F.slice(parts, 1, limit)), ", "), F.lit(""))


#: Display names of disease codes.
DISEASE_NAMES = {
    "ALL": "Acute lymphoblastic leukemia", "BLCA": "Bladder", "BRCA": "Breast", "CLL": "Chronic lymphocytic leukemia",
    "COAD/READ": "Colorectal", "DLBC": "Diffuse large B-cell lymphoma", "ESCA": "Esophageal", "GBM": "Glioblastoma",
    "HNSC": "Head & neck", "KIRC": "Kidney, clear cell", "LAML": "Acute myeloid leukemia", "LCML": "Chronic myeloid leukemia",
    "LGG": "Low-grade glioma", "LIHC": "Liver", "LUAD": "Lung adenocarcinoma", "LUSC": "Lung squamous", "MB": "Medulloblastoma",
    "MESO": "Mesothelioma", "MM": "Multiple myeloma", "NB": "Neuroblastoma", "OV": "Ovarian", "PAAD": "Pancreatic",
    "PRAD": "Prostate", "SARC": "Sarcoma", "SCLC": "Small-cell lung", "SKCM": "Melanoma", "STAD": "Gastric", "THCA": "Thyroid",
    "UCEC": "Endometrial",
}


def pretty_disease(code: Column) -> Column:
    """a code's display name; SITE_ codes in title case; a blank one is unknown, others stay."""
    site = F.initcap(F.replace(F.substring(code, 6, 1000), F.lit("_"), F.lit(" ")))
    names = F.create_map(*(F.lit(v) for pair in DISEASE_NAMES.items() for v in pair))
    return (
        F.when(F.coalesce(code, F.lit("")) == "", "unknown")
        .when(code.startswith("SITE_"), site)
        .when(F.upper(code) == "UNABLE TO CLASSIFY", "Unclassified")
        .otherwise(F.coalesce(F.try_element_at(names, code), code))
    )


def norm_label(x: Column) -> Column:
    """what stands before ``=``, trimmed, upper case, spaces dropped, slashes and hyphens as underscores."""
    return F.translate(F.upper(F.trim(F.split_part(x, F.lit("="), F.lit(1)))), "/- ", "__")


def prettify(x: Column) -> Column:
    """lower case with spaces for underscores."""
    return F.lower(F.replace(x, F.lit("_"), F.lit(" ")))


def pretty_set_name(x: Column, prefix_length: int = 9) -> Column:
    """a set's name without its collection prefix, in title case."""
    return F.initcap(F.replace(F.substring(x, F.lit(prefix_length + 1), F.length(x)), F.lit("_"), F.lit(" ")))


def to_float(x: Column) -> Column:
    """A finite number or null; never an error."""
    number = F.try_cast(x, "double") if hasattr(F, "try_cast") else x.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def to_int(x: Column) -> Column:
    """a finite number rounded half to even, or null."""
    return F.bround(to_float(x), 0).cast("long")


def split_genes(x: Column, separator: str = "/") -> Column:
    """the trimmed, non-blank parts."""
    return F.filter(F.transform(F.split(x, separator), lambda s: F.trim(s)), lambda s: s != "")


def name_prefix(x: Column, separator: str = "_") -> Column:
    return F.split_part(x, F.lit(separator), F.lit(1))


def file_safe(x: Column, other: str = "-") -> Column:
    """usable as part of a file name."""
    return F.replace(x, F.lit("/"), F.lit(other))


def unit_key(a: Column, b: Column) -> Column:
    """the key of a unit of work."""
    return F.concat_ws("__", file_safe(a), b)


def nan_to_null(x: Column) -> Column:
    """NaN and infinities are nulls."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def digest_score(x: Column, low: float = 0.55, high: float = 0.95) -> Column:
    """a stable stand-in score from a hash of the text."""
    part = F.conv(F.substring(F.sha2(x, 256), 1, 8), 16, 10).cast("double")
    return F.lit(low) + (high - low) * (part % 10_000) / 9_999.0


def short_label(x: Column, limit: int = 50) -> Column:
    """Title case, cut with an ellipsis."""
    nice = F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))
    return F.when(F.length(nice) > limit, F.concat(F.substring(nice, 1, limit), F.lit("..."))).otherwise(nice)


def site_label(x: Column) -> Column:
    """Slash as hyphen, no SITE_ prefix."""
    return F.regexp_replace(F.replace(x, F.lit("/"), F.lit("-")), "^SITE_", "")


#: The pattern of catalogue codes, the parts of names that are no therapies, statuses of tool compounds.
ID_PATTERN = r"(?i)^(\d+|BRD[-_ ]?[A-Za-z]?\d.*|BD[A-Z]{1,5}\d.*|NSC[-_ ]?\d.*|SID\s*\d+|CIL\d+)$"
DENIED = ("staurosporine", "acetalax", "oxyphenisatin", "ouabain", "digoxin", "digitoxin", "glutathione", "acetyl cysteine", "acetylcysteine", "picolin")
PROBE_STATUS = ("probe", "GE-active")


def actionable(name: Column, pattern: str = ID_PATTERN, denied: tuple[str, ...] = DENIED) -> Column:
    """A name that is neither blank nor a catalogue code nor holds a denied part."""
    trimmed = F.trim(name)
    good = (trimmed != "") & ~trimmed.rlike(pattern)
    for part in denied:
        good = good & ~F.lower(trimmed).contains(part)
    return F.coalesce(good, F.lit(False))
