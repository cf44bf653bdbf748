"""Designations of cables: parts of the grammar as columns, and clean-up after OCR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import squeeze

_SIZE = r"(\d+)\s*[xXхХ×]\s*(?:(\d+)\s*[xXхХ×]\s*)?(\d+(?:[.,]\d+)?)"


def parse_mark(x: Column) -> Column:
    """struct<brand, fire_class, cores, groups, size, has_armor, is_lan>.

    'NxS' is N cores; 'GxNxS' is G groups of N cores and a LAN cable in mm. A designation without a size has one
    core in one group of size 1.
    """
    text = squeeze(x)
    a, b, c = (F.regexp_extract(text, _SIZE, i) for i in (1, 2, 3))
    three = b != ""
    number = lambda s: s.try_cast("int")
    return F.struct(
        F.regexp_extract(text, r"^([^\s\d]+)", 1).alias("brand"),
        F.regexp_extract(text, r"(?iu)нг\s*\(?([a-dа-в])\)?(?:-[a-zа-я]+)*", 0).alias("fire_class"),
        F.when(a == "", 1).when(three, number(a) * number(b)).otherwise(number(a)).alias("cores"),
        F.when(three, number(a)).otherwise(1).alias("groups"),
        F.when(c == "", 1.0).otherwise(F.translate(c, ",", ".").try_cast("double")).alias("size"),
        (F.contains(text, F.lit("Бб")) | text.rlike("БШ|К[лп]")).alias("has_armor"),
        (three | text.rlike("(?iu)utp|ftp|lan")).alias("is_lan"),
    )


def complexity(mark: Column, cores: Column, size: Column, armor: Column) -> Column:
    """Work factor of a sample: 1 (wire 0.5), and 0.5 more for armour, over 10 cores, and over 10 in size."""
    text = F.coalesce(mark, F.lit(""))
    prefix = F.upper(F.regexp_extract(text, r"^(\S+)", 1)).rlike("^(" + "|".join(rules.WIRE_PREFIXES) + ")")
    wire = F.contains(F.lower(text), F.lit("провод")) | (~F.contains(F.lower(text), F.lit("кабель")) & prefix)
    half = lambda c: F.when(c, 0.5).otherwise(0.0)
    return F.when(wire, 0.5).otherwise(1.0) + half(armor) + half(cores > 10) + half(size > 10)


def after_ocr(x: Column) -> Column:
    """Latin letters that look like Cyrillic ones are replaced where the word has Cyrillic letters; spacing is mended."""
    text = squeeze(x)
    text = F.regexp_replace(text, r"(\d)\s*[xXхХ*×]\s*(?=\d)", "$1х")
    text = F.regexp_replace(text, r"(?u)нг\s*\(\s*([A-Da-dА-Га-г])\s*\)\s*-?\s*", "нг($1)-")
    text = F.regexp_replace(text, "-$|-(?= )", "")
    words = F.transform(F.split(text, " "), lambda w: F.when(w.rlike("[А-Яа-яЁё]"), F.translate(w, "ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху")).otherwise(w))
    return F.array_join(words, " ")


def bare_brand(x: Column) -> Column:
    """A designation without its fire class or climate suffix, and without the dashes and spaces that then end it."""
    cut = F.regexp_replace(F.regexp_replace(F.trim(x), rules.FIRE_CLASS, ""), rules.CLIMATE_SUFFIX, "")
    return F.regexp_replace(F.regexp_replace(cut, "^[- ]+", ""), "[- ]+$", "")
