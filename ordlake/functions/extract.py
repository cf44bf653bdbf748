"""Columns that read facts out of document text: norm references, clauses, contacts, organisations, table rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import clauses, let, organisation_key, squeeze

#: Case-insensitive, with Unicode letters in \w and \b.
_I = "(?iuU)"


def norm_document(x: Column) -> Column:
    """The first norm reference by preference (a full TU, then GOST or IEC, then a short TU), or null.

    Read word by word: a word that names a kind of norm, in whatever alphabet its letters were typed, and the number
    after it. A reference needs five characters and a digit, and none of the words that only look like one.
    """
    text = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?iu)(?<=ту|tu|ty|гост|мэк)(?=\d)", " ")  # a number typed on to its kind
    words = F.filter(F.split(F.regexp_replace(text, r"\s*([-–/])\s*(?=\d)", "$1"), r"[\s,;:()«»\"]+"), lambda w: w != "")
    upper = lambda ws: F.transform(ws, lambda w: F.translate(F.upper(w), "TUY", "ТУУ"))
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

    def reference(ws: Column, kinds: Column, kind: Column, i: Column) -> Column:
        number = F.regexp_replace(F.regexp_replace(at(ws, i + 1), r"(?iu)(?<=\.)[kк](?=\d)", "К"), r"[^\p{L}\p{N}]+$", "")
        named = F.when(kind.isin("ТУ", "ГОСТ"), kind).when((kind == "МЭК") & (at(kinds, i - 1) == "Р"), F.lit("Р МЭК"))
        rank = F.when((named == "ТУ") & number.rlike(r"^\d+\.К\d{2,3}(-\d+){2}$"), 1).when(named != "ТУ", 2).otherwise(3)
        found = F.concat(named, F.lit(" "), number)
        good = number.rlike(r"\d") & (F.length(found) >= 5) & ~found.rlike(_I + rules.NOT_A_DOCUMENT) & ~((rank == 3) & number.rlike(r"^\d+$"))
        return F.when(named.isNotNull() & good, F.struct(rank.alias("rank"), i.alias("i"), found.alias("found")))

    def references(ws: Column) -> Column:
        return let(upper(ws), lambda kinds: F.transform(kinds, lambda kind, i: reference(ws, kinds, kind, i)))

    return F.array_min(F.array_compact(let(words, references)))["found"]


#: What may stand in a text as far as clause numbers go: numbers with dots, words, single signs.
_TOKEN = r"\d+(?:\.\d+){1,5}|[^\s\p{P}\p{S}\d]+\.?|\S"


def _is_date(number: Column) -> Column:
    parts = F.split(number, r"\.")
    return (F.size(parts) == 3) & F.forall(parts, lambda p: F.length(p) >= 2) & (F.element_at(parts, -1).cast("int") > 31)


def cited_clauses(x: Column) -> Column:
    """Distinct clause numbers that a word calls for; dates are left out.

    The text is read token by token. After a word that ends in 'п', 'пп' or 'пункт(ы)' numbers are taken as long as
    commas, semicolons or 'и' join them; after one for requirements, methods or checks one number is taken, also
    past a dash or a colon.
    """
    tokens = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("(?U)" + _TOKEN), 0)
    word = lambda t: F.lower(F.rtrim(t, F.lit(".")))
    state = F.struct(F.lit("").alias("mode"), F.lit(False).alias("after"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        number, w = t.rlike(r"^\d+(\.\d+)+$"), word(t)
        calls_list = F.endswith(w, F.lit("п")) | w.rlike("пункт[ыа]?$")
        calls_one = w.rlike("требовани[ея]$") | F.endswith(w, F.lit("метод")) | w.rlike("(методик|проверк)[а-яё]*$")
        taken = number & (s["mode"] != "") & ~((s["mode"] == "list") & s["after"])
        joins = (s["mode"] == "list") & s["after"] & (t.isin(",", ";") | (w == "и"))
        passes = (s["mode"] == "one") & t.isin("—", "-", ":", ".")
        waits = (s["mode"] == "list") & ~s["after"] & (t == ".")
        mode = F.when(taken, F.when(s["mode"] == "list", "list").otherwise("")).when(joins | waits | passes, s["mode"]).when(calls_list, "list").when(calls_one, "one").otherwise("")
        found = F.when(taken, F.concat(s["found"], F.array(t))).otherwise(s["found"])
        return F.struct(mode.alias("mode"), taken.alias("after"), found.alias("found"))

    return F.array_distinct(F.filter(F.aggregate(tokens, state, step)["found"], lambda c: ~_is_date(c)))


def clause_line(line: Column) -> Column:
    """struct<clause, title> of '1.4.1 Title' or 'С1 | Title | 2.3.1 - 2.3.6 |', else null."""
    text = F.trim(F.translate(line, "\u00a0", " "))
    cells, words = F.transform(F.split(text, r"\|"), lambda c: F.trim(c)), F.split(text, r"\s+", 2)
    bare = lambda c: F.trim(c, F.lit(" .;—-"))
    size = lambda c, low, high: F.length(c).between(low, high)
    title = F.trim(F.get(words, F.lit(1)))
    numbered = F.get(words, F.lit(0)).rlike(r"^\d+(\.\d+){1,4}$") & size(title, 8, 200)
    row = (F.size(cells) > 3) & ~F.get(cells, F.lit(0)).rlike(r"^$|\s") & size(F.get(cells, F.lit(1)), 6, 160) & F.get(cells, F.lit(2)).rlike(r"^[\d.,\s–—-]+$")
    number = F.array_compact(F.transform(F.split(F.get(cells, F.lit(2)), r"[^\d.]+"), lambda n: F.when(n.rlike(r"^\d+\.\d"), n)))
    found = F.when(numbered, F.struct(F.get(words, F.lit(0)).alias("clause"), bare(title).alias("title"))).when(row, F.struct(F.coalesce(F.get(number, F.lit(0)), F.lit("")).alias("clause"), bare(F.get(cells, F.lit(1))).alias("title")))
    return F.when(F.length(text) >= 12, found)


def full_fire_marks(x: Column) -> Column:
    """Designations with a complete fire class, such as 'ВВГнг(А)-LS', in order, without copies.

    Each word is cut at its class: a name before it, the letter А in brackets, and then parts between dashes, of which the first
    is one of rules.FIRE_SUFFIXES and the others have up to twelve letters or digits.
    """
    joined = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*\(\s*", "("), r"\s+\)", ")")
    words = F.transform(F.split(joined, r"[\s,;:«»\"]+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+$", ""))

    def mark(word: Column) -> Column:
        sides = F.split(word, _I + r"нг\(", 2)
        name, tail = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.lit(""))
        parts = F.filter(F.split(F.substring(tail, 3, 1000), "-"), lambda p: p != "")
        classed = F.upper(F.substring(tail, 1, 2)).isin("А)", "A)") & F.upper(F.get(parts, F.lit(0))).isin(rules.FIRE_SUFFIXES)
        named = F.length(name).between(3, 51) & name.rlike(r"^\p{L}[\p{L}\p{N}-]*$")
        short = F.forall(parts, lambda p: F.length(p) <= 12)
        return F.when(classed & named & short, F.concat(name, F.lit("нг(А)"), F.substring(tail, 3, 1000)))

    return F.array_distinct(F.array_compact(F.transform(words, mark)))


def sized_marks(x: Column) -> Column:
    """Designations with a size, such as 'ВВГнг(А)-LS 3х2,5', in order, without copies."""
    pattern = _I + r"\b[А-ЯЁA-Z][А-ЯЁа-яёA-Za-z0-9()\-]{1,40}\s+\d+\s*[хx×]\s*\d+(?:[.,]\d+)?(?:\s*[хx×]\s*\d+(?:[.,]\d+)?)?"
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), 0), squeeze))


def with_context(text: Column, found: Column, radius: int = 160) -> Column:
    """Each found string with the text around its first place."""
    at = lambda m: F.instr(text, m)
    return F.transform(found, lambda m: F.struct(m.alias("mark"), squeeze(F.substr(text, F.greatest(at(m) - radius, F.lit(1)), F.least(at(m) - 1, F.lit(radius)) + F.length(m) + radius)).alias("context")))


def plausible_mark(m: Column) -> Column:
    """A designation: begins with a capital, has a size, is no price or date, and its name has 3 to 100 characters."""
    name = F.regexp_extract(m, r"^(.*?)(?:\s+\d.*)?$", 1)
    size = m.rlike(_I + r"\d+\s*[хx]\s*[\d.,а-яёa-z]") | m.rlike(r"\d+\*[\d.,]")
    bad = m.rlike(r"\d{4,},\d{2}") | m.rlike(r"\d{2}\.\d{4}") | m.rlike(_I + r"^(?:нг\(|кВ\s*\d|ТУ\b|ГОСТ\b|СТО\b)")
    return m.rlike("^[А-ЯЁA-Z]") & size & ~bad & F.length(name).between(3, 100)


def organisation_type(text: Column, name: Column) -> Column:
    """Kind by the first pattern that the name, and then the text, matches; unknown if none does."""
    out = F.lit("unknown")
    for source in (text, name):
        for kind, pattern in reversed(rules.ORGANISATION_TYPES):
            out = F.when(F.coalesce(source, F.lit("")).rlike(_I + pattern), kind).otherwise(out)
    return out


def testing_center(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(_I + rules.TESTING_CENTER)


def _unnamed(raw: Column) -> Column:
    """True for no name or a login."""
    return (raw == "") | raw.rlike(r"^[a-z]\.[a-z]{3,20}$")


def _holds(key: Column, own: list[str]) -> Column:
    """Whether a normalised name holds one of the names own, spaces and dashes aside."""
    close = lambda k: reduce(lambda a, sign: F.replace(a, F.lit(sign), F.lit("")), " –—-", k)
    keys = [close(organisation_key(F.lit(o))) for o in own]
    return reduce(lambda a, b: a | b, [(k != "") & F.contains(close(key), k) for k in keys], F.lit(False))


def placeholder(name: Column) -> Column:
    """True for no name, a login or a word such as 'заказчик'."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    return _unnamed(raw) | organisation_key(raw).isin(rules.PLACEHOLDER_NAMES)


def own_laboratory(name: Column, own: list[str]) -> Column:
    """True for a name of our own laboratory: one of the names own, or a name that holds one of them, spaces and dashes aside."""
    return _holds(organisation_key(name), own)


def nobody(name: Column, own: list[str]) -> Column:
    """placeholder or own_laboratory, with the name normalised once."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    return _unnamed(raw) | let(organisation_key(raw), lambda k: k.isin(rules.PLACEHOLDER_NAMES) | _holds(k, own))


def labelled(text: Column, label: str) -> Column:
    """What follows 'label:' on its line, up to a comma, or null."""
    got = squeeze(F.regexp_extract(F.coalesce(text, F.lit("")), _I + rf"{label}\s*[:\-]\s*([^\n,]+)", 1))
    return F.when(F.length(organisation_key(got)) >= 4, got)


#: How much of a letter is its head if it has no date, where its recipient stands, and what each fact found adds to a letter's confidence.
HEAD_CHARS, RECIPIENT_CHARS, LETTER_BASE, LETTER_WEIGHTS = 2000, 800, 0.55, {"sender": 0.2, "address": 0.15, "inn": 0.1}


def _first_in(lines: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern finds in the first line that has it, squeezed, or null."""
    found = F.transform(lines, lambda line: squeeze(F.regexp_extract(line, _I + pattern, group)))
    return F.get(F.filter(found, lambda f: f != ""), F.lit(0))


def letter(text: Column) -> Column:
    """struct<recipient, sender, address, inn, kpp, phone, email, confidence> of the lines above a letter's date."""
    whole = F.coalesce(text, F.lit(""))
    above = F.split(whole, r"\b\d{2}\.\d{2}\.\d{4}\b", 2)
    lines = F.split(F.when(F.size(above) > 1, F.get(above, F.lit(0))).otherwise(F.substring(whole, 1, HEAD_CHARS)), "\n")
    own = F.filter(lines, lambda line: ~F.exists(F.split(F.lower(line), r"[^\p{L}]+"), lambda w: w.isin(rules.SALUTATIONS)))
    facts = {"sender": (rules.SENDER, 1), "address": (rules.STREET, 1), "inn": (rules.TAX_IDS, 1), "kpp": (rules.TAX_IDS, 2), "phone": (rules.PHONE, 1), "email": (rules.EMAIL, 1)}
    got = {name: _first_in(own, pattern, group) for name, (pattern, group) in facts.items()}
    confidence = sum((F.when(got[name].isNotNull(), w).otherwise(0.0) for name, w in LETTER_WEIGHTS.items()), F.lit(LETTER_BASE))
    recipient = _first_in(F.split(F.substring(whole, 1, RECIPIENT_CHARS), "\n"), rules.RECIPIENT)
    return F.struct(recipient.alias("recipient"), *[c.alias(name) for name, c in got.items()], F.least(F.round(confidence, 2), F.lit(0.95)).alias("confidence"))


def acceptance_row(cells: Column) -> Column:
    """struct<group_code, category, name, requirements, methods, billable> of a table row, or null for other rows."""
    first = F.regexp_replace(F.translate(F.upper(F.get(cells, F.lit(0))), "CPT", "СПТ"), r"\s+", "")
    grouped = first.rlike(r"^[СПТ]\d+")
    cell = lambda i: squeeze(F.get(cells, F.when(grouped, i + 1).otherwise(i)))
    name, requirements, methods = cell(0), clauses(cell(1)), clauses(cell(2))
    numbers = lambda a: F.filter(a, lambda c: c.rlike(r"^\d+(?:\.\d+){1,5}$"))
    category = F.when(first.startswith("С"), "psi").when(first.startswith("П"), "periodic").when(first.startswith("Т"), "type")
    good = (F.size(cells) >= 3) & (F.length(name) >= 4) & ~name.rlike(_I + r"^(?:гост|iec)\b|вид испытания|^испытания проводят|^правила прием") & (F.size(numbers(requirements)) + F.size(numbers(methods)) > 0)
    row = F.struct(F.when(grouped, F.regexp_extract(first, r"^([СПТ]\d+)", 1)).alias("group_code"), F.when(grouped, category).alias("category"), name.alias("name"), numbers(requirements).alias("requirements"), numbers(methods).alias("methods"), (~name.rlike(_I + rules.NOT_BILLABLE)).alias("billable"))
    return F.when(good, row)


def table_header(cells: Column) -> Column:
    """True for the head of an acceptance table."""
    row = F.lower(F.array_join(cells, " "))
    return row.rlike("вид испытан|вид провер|наименование") & row.rlike("требован|пункт|метод")


def column_places(cells: Column, wanted: dict[str, str]) -> Column:
    """For every wanted name the place (from 0, or -1) of the first head cell that matches its pattern."""
    first = lambda p: F.array_position(F.transform(cells, lambda c: F.lower(c).rlike(p)), F.lit(True)).cast("int") - 1
    return F.struct(*[first(p).alias(name) for name, p in wanted.items()])


def customer_hint(path: Column) -> Column:
    """The folder of a path that most likely names the customer, or '' if none does.

    Folders are read from the nearest one up. Years, drives, shares, logins, designations and folders of rules.PASSED_FOLDERS are
    passed over, logins and designations only without a word that tells an organisation. The first folder with such a
    word or one of the trade is taken, else the first short Latin code, else the first that is left.
    """
    has = lambda f, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(f), w))
    company = lambda f: has(f, rules.ORGANISATION_WORDS) | f.rlike(_I + "(" + "|".join(rules.ORGANISATION_ENDINGS) + r")\b")
    login = lambda f: f.rlike(r"(?i)^[a-z][a-z0-9]*\.[a-z][a-z0-9._-]*$") & (F.length(F.substring_index(f, ".", 1)) <= 21) & (F.length(f) - F.instr(f, ".") <= 31)
    mark = lambda f: f.rlike(_I + r"\d\s*[xх×]\s*\d|нг\s*\(") | F.exists(F.array(*[F.lit(w) for w in rules.MARK_BEGINNINGS]), lambda w: F.startswith(F.lower(f), w))
    passed = lambda f: F.lower(squeeze(f)).isin(rules.PASSED_FOLDERS) | f.rlike(r"^\d{4}$") | f.rlike("[:$]$") | (F.length(f) < 2) | (f == "..")
    folders = F.transform(F.split(F.coalesce(path, F.lit("")), r"[/\\]+"), lambda f: F.trim(f))
    nearest = F.reverse(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))))
    kept = F.filter(nearest, lambda f: ~passed(f) & (company(f) | ~(login(f) | mark(f))))
    first = lambda fs, good: F.get(F.filter(fs, good), F.lit(0))
    chosen = lambda fs: F.coalesce(first(fs, lambda f: company(f) | has(f, rules.TRADE_WORDS)), first(fs, lambda f: f.rlike("^[A-Za-z][A-Za-z0-9_-]{1,15}$")), first(fs, lambda f: ~login(f)), F.lit(""))
    return let(kept, chosen)


def document_and_clause(x: Column, default: str = "") -> Column:
    """struct<document, clause> of a cell such as 'ТУ 16.К99-058-2014 (1.4.1)': its first reference to a TU and what is left.

    Digits in brackets at the end are the clause; without a reference the cell is a clause of the default document, and a
    cell that is only a reference is also its own clause. Dashes become '-'.
    """
    text = squeeze(x)
    number = r"(?iuU)\bТУ\s+\d[\w.–—-]*"
    found = F.regexp_extract(text, number, 0)
    dashes = lambda c: F.translate(c, "–—÷", "---")
    rest = F.trim(F.concat(F.substr(text, F.lit(1), F.instr(text, found) - 1), F.substr(text, F.instr(text, found) + F.length(found))), F.lit(" ,;()"))
    inner = F.trim(F.regexp_extract(text, r"\(([^)]*\d[^)]*)\)\s*$", 1))
    clause = F.when(inner != "", inner).when(rest != "", rest).otherwise(text)
    alone = F.when(text.rlike(r"(?iu)^[\d\s,.;÷+()табл.п–—-]+$"), dashes(text)).otherwise(text)
    return F.when(found != "", F.struct(dashes(found).alias("document"), clause.alias("clause"))).otherwise(F.struct(F.lit(default).alias("document"), alone.alias("clause")))


def clause_tokens(clause: Column) -> Column:
    """The parts of a clause list that have a digit, parted by spaces, commas and semicolons."""
    return F.filter(F.split(F.translate(F.coalesce(clause, F.lit("")), "÷", "-"), r"[\s,;]+"), lambda p: p.rlike(r"\d"))
