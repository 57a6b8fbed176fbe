"""Column functions on file names, folders and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of classes and modalities.
CLASS_OF_WORD = {
    "курганы_поврежденные": "kurgany_povrezhdennye",
    "курганы_целые": "kurgany_tselye",
    "городища": "gorodishcha",
    "городище": "gorodishcha",
    "фортификации": "fortifikatsii",
    "фортификация": "fortifikatsii",
    "архитектуры": "arkhitektury",
    "архитектура": "arkhitektury",
    "FindsPoints": "finds_points",
    "ObjectPoly": "object_poly",
}
MODALITY_OF_TOKEN = {"Li": "Li", "Ae": "Ae", "Ае": "Ae", "SpOr": "SpOr", "Sp": "SpOr", "Or": "Or", "MagGr": "MagGr", "GeoGr": "GeoGr"}
TARGET_MODALITIES = ["MagGr", "Ae", "SpOr", "Li", "Or"]
MODALITY_BY_PART = [("li", "Li"), ("ae", "Ae"), ("ае", "Ae"), ("spor", "SpOr"), ("sp", "SpOr"), ("or", "Or")]
CLASS_BY_PART = [
    ("курганы_целые", "kurgany_tselye"),
    ("курганы_поврежденные", "kurgany_povrezhdennye"),
    ("городища", "gorodishcha"),
    ("фортификации", "fortifikatsii"),
    ("архитектуры", "arkhitektury"),
]
CLASS_IDS = {"background": 0, "kurgany_tselye": 1, "kurgany_povrezhdennye": 2, "gorodishcha": 3, "fortifikatsii": 4, "arkhitektury": 5}


def lookup(key: Column, table: dict) -> Column:
    """table[key], null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def first_match(rules: list[tuple[Column, str]], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    chain = reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))
    return chain.otherwise(otherwise)


def class_word(stem: Column) -> Column:
    named = [(stem.contains(w), w) for w in ("курганы_поврежденные", "курганы_целые")]
    return first_match(named, F.element_at(F.split(stem, "_"), -1))


def class_by_rule(stem: Column) -> Column:
    low = F.lower(stem)
    return first_match([(low.contains(p), c) for p, c in CLASS_BY_PART], F.lit(None).cast("string"))


def type_tag(stem: Column) -> Column:
    """whole, damaged or unknown."""
    return first_match([(stem.contains("курганы_целые"), "whole"), (stem.contains("курганы_поврежденные"), "damaged")], F.lit("unknown"))


def fold(text: Column) -> Column:
    """Lower case, with the Cyrillic letters that look like c, o and p as those."""
    return F.translate(F.lower(text), "сор", "cop")


def modality_by_rule(name: Column) -> Column:
    folded = fold(name)
    return first_match([(folded.contains(p), m) for p, m in MODALITY_BY_PART], F.lit("Unknown"))


def layer_modality(stem: Column) -> Column:
    """Modality of an annotation file by its infix."""
    folded, low = fold(stem), F.lower(stem)
    return first_match([
        (folded.contains("_li_"), "Li"), (low.contains("_ae_") | low.contains("_ае_"), "Ae"),
        (folded.contains("_spor_"), "SpOr"), (folded.contains("_or_"), "Or")], F.lit("Unknown"))


def folder_modality(name: Column) -> Column:
    """Modality of a folder by its infix or suffix, lidar by its infix or prefix; null if none."""
    folded, low = fold(name), F.lower(name)

    def part(text: Column, word: str) -> Column:
        return text.contains(f"_{word}_") | text.endswith(f"_{word}")

    return first_match([
        (folded.contains("_li_") | folded.startswith("li_"), "Li"), (part(low, "ae") | part(low, "ае"), "Ae"),
        (part(folded, "spor"), "SpOr"), (part(folded, "or"), "Or")], F.lit(None).cast("string"))


def _known(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: lookup(t, MODALITY_OF_TOKEN))


def token_place(stem: Column) -> Column:
    """Place, from 1, of the first token that is a modality; 0 if none is."""
    return F.coalesce(F.array_position(F.transform(_known(F.split(stem, "_")), lambda m: m.isNotNull()), True), F.lit(0)).cast("int")


def region_and_modality(stem: Column) -> tuple[Column, Column]:
    """Both "unknown" without a modality token; the region also if that token comes first."""
    place, tokens = token_place(stem), F.split(stem, "_")
    region = F.when(place > 1, F.array_join(F.slice(tokens, 1, F.greatest(place - 1, F.lit(0))), "_"))
    modality = F.when(place > 0, lookup(F.get(tokens, place - 1), MODALITY_OF_TOKEN))
    return F.coalesce(region, F.lit("unknown")), F.coalesce(modality, F.lit("unknown"))


def modality_from_path(stem: Column, path: Column) -> Column:
    """The first target modality among the tokens of the stem, then of every part of the path; null if none."""
    tokens = F.concat(F.split(stem, "_"), F.flatten(F.transform(F.split(path, "/"), lambda p: F.split(p, "_"))))
    return F.get(F.filter(_known(tokens), lambda m: m.isin(TARGET_MODALITIES)), F.lit(0))


def region_from_folder(folder: Column) -> Column:
    return F.coalesce(F.get(F.split(folder, "_"), F.lit(1)), folder)


def map_type(stem: Column) -> Column:
    return F.when(stem.rlike("^[0-9]+$"), F.lit("")).otherwise(F.regexp_replace(stem, "^[0-9]+_", ""))


def map_suffix(stem: Column, modality: Column) -> Column:
    last = F.element_at(F.split(stem, "_"), -1)
    return F.when((modality == "Li") & last.isin("c", "ch", "g", "i"), last)


def safe_stem(text: Column) -> Column:
    return F.translate(text, "/\\ :", "____")


def sample_key(sample_id: Column) -> Column:
    """At least six digits, without a trailing .0; longer ones stay whole."""
    s = F.regexp_replace(sample_id.cast("string"), r"\.0$", "")
    return F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)


def epsg(crs_urn: Column) -> Column:
    return F.regexp_extract(crs_urn, "EPSG::([0-9]+)", 1).cast("int")


def draw(key: Column, seed: int) -> Column:
    """One of 2**52 numbers in [0, 1) that depends on the key's text and the seed alone, the same in any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
