"""Column functions over text: normal forms, word sets, ratios, clause lists, classification."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row; in functions over arrays it would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(x: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def phrase(x: Column) -> Column:
    """Lower case, ё as е; dashes, plus signs and all else but words, / % and ° become single spaces."""
    low = F.translate(F.lower(F.coalesce(x, F.lit(""))), "ё\u00a0±+-–—", "е      ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s/%°]", " "), r"\s+", " "))


def requirement(x: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(x, F.lit(""))), "\u00a0", " "), r"\s+", " "))


def word_set(x: Column, least: int = 3, stop: list[str] = rules.STOP_WORDS) -> Column:
    """Distinct words of a phrase of at least so many characters, without stop words."""
    return F.array_sort(F.array_distinct(F.filter(F.split(phrase(x), " "), lambda w: (F.length(w) >= least) & ~w.isin(stop))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def organisation_key(x: Column) -> Column:
    """Lower-case name without quotes, leading legal forms (each once, in their order) and outer signs."""
    bare = F.trim(F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(x, F.lit("")))), "«»\"'`{}[]", ""), r"\s+", " "))
    forms = "".join(f"(?:{form} )?" for form in rules.LEGAL_FORMS)
    return F.regexp_replace(F.regexp_replace(bare, rf"^{forms}[ .,;-]*", ""), r"[ .,;-]+$", "")


def mark_key(x: Column) -> Column:
    """Key under which two spellings of a designation are equal: lower case, х and × as x, decimal points, no spaces."""
    low = F.translate(F.lower(F.coalesce(x, F.lit(""))), "х×", "xx")
    return F.regexp_replace(F.regexp_replace(low, r"(\d),(\d)", "$1.$2"), r"\s+", "")


def letters_share(x: Column, letters: str) -> Column:
    """Share of the letters of one alphabet (a regex class) in all Latin and Cyrillic letters; 0 without letters."""
    only = lambda t, kept: F.regexp_replace(t, f"[^{kept}]++", "")
    share = lambda a: F.coalesce(F.try_divide(F.length(only(a, letters)), F.length(a)), F.lit(0.0))
    return let(only(F.coalesce(x, F.lit("")), "A-Za-zА-Яа-яЁё"), share)  # letters of one alphabet stand among all letters


def needs_ocr(x: Column, has_images: Column) -> Column:
    """True for empty text, or for pages with pictures and hardly any Cyrillic letters."""
    return (F.length(squeeze(x)) == 0) | (has_images & (letters_share(x, "А-Яа-яЁё") < rules.CYRILLIC_MIN))


def first_match(x: Column, table: list[tuple[str, list[str]]], default: str) -> Column:
    """Key of the first row of table any of whose words stands in x."""
    low = F.lower(squeeze(x))
    out = F.lit(default)
    for key, words in reversed(table):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), key).otherwise(out)
    return out


def test_type(x: Column) -> Column:
    return first_match(x, rules.TEST_TYPES, rules.DEFAULT_TEST_TYPE)


def document_type(x: Column) -> Column:
    """letter, direction, act or unknown; texts under 40 characters are unknown."""
    text = F.coalesce(x, F.lit(""))
    head = F.substring(text, 1, 3000)
    letter = head.rlike(r"(?iu)Генеральному|Уважаем[а-яё]+") & head.rlike(r"(?iu)Просим\s+.*провести|периодическ")
    direction = text.rlike("(?iu)НАПРАВЛЕНИЕ") & text.rlike("(?iu)испытательн")
    act = text.rlike(r"(?iu)Акт\s+отбора|отбор\s+образцов")
    return F.when(F.length(text) < 40, "unknown").when(letter, "letter").when(direction, "direction").when(act, "act").otherwise("unknown")


def clause_range(x: Column, span: int = 40) -> Column:
    """Clauses of one reference: '2.3.1 - 2.3.6' becomes six; wider spans and other texts stay as they are."""
    text = squeeze(x)
    shape = r"^((?:\d+\.)+)(\d+)\s*[-–—]\s*(?:\d+\.)*?(\d+)$"
    low, high = F.regexp_extract(text, shape, 2).try_cast("int"), F.regexp_extract(text, shape, 3).try_cast("int")
    numbers = F.transform(F.sequence(low, high), lambda n: F.concat(F.regexp_extract(text, shape, 1), n.cast("string")))
    return F.when(text.rlike(shape) & (high >= low) & (high - low < span), numbers).otherwise(F.array(text))


def clauses(x: Column) -> Column:
    """Distinct clauses of a comma-separated list, ranges expanded, order kept."""
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(F.coalesce(x, F.lit("")), r"[,;]"), lambda p: F.length(F.trim(p)) > 0), lambda p: clause_range(p))))


def slug(x: Column, size: int = 55) -> Column:
    """Words joined by underscores, at most size characters."""
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^0-9a-zа-яё_]+", " ")), " ", "_"), 1, size)


def jammed(x: Column) -> Column:
    """The names of tests in one cell: two if a second one begins with a capital opening word, else one."""
    opening = "(?:" + "|".join(rules.OPENING_WORDS) + ")"
    shape = rf"^({opening}\s.+?)\s+({opening}\s.+)$"
    return F.when(x.rlike(shape), F.array(F.regexp_extract(x, shape, 1), F.regexp_extract(x, shape, 2))).otherwise(F.array(x))


def file_part(x: Column, size: int = 60, default: str = "file") -> Column:
    """A part of a file name without reserved signs."""
    bare = F.substring(squeeze(F.regexp_replace(F.coalesce(x, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', " ")), 1, size)
    return F.when(F.length(bare) > 0, bare).otherwise(default)


def character_error_rate(predicted: Column, truth: Column) -> Column:
    """Edit distance over the truth's length; null without truth, 1 without a prediction."""
    a, b = squeeze(predicted), squeeze(truth)
    return F.when(F.length(b) == 0, F.lit(None).cast("double")).when(F.length(a) == 0, 1.0).otherwise(F.levenshtein(a, b) / F.length(b))


def drop_repeated_neighbours(parts: Column) -> Column:
    """An array without elements equal to the one before: merged cells, repeated lines."""
    return F.filter(parts, lambda p, i: (i == 0) | (p != F.get(parts, F.greatest(i - 1, F.lit(0)))))


def table_text(tables: Column) -> Column:
    """Tables of rows of cells as lines of text."""
    return F.array_join(F.transform(F.flatten(tables), lambda row: F.array_join(row, " ")), "\n")


def summary(names: Column, first: int = 3) -> Column:
    """The first names and how many follow."""
    rest = F.size(names) - first
    return F.concat(F.array_join(F.slice(names, 1, first), ", "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(""))
