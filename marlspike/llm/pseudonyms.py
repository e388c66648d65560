"""Format-preserving pseudonyms by a keyed Feistel network, in SQL expressions only.

A text is searched once for candidates: payment cards, telephone numbers, IPv4 addresses, US social security numbers,
dates, local parts of e-mail addresses, and values assigned to names like token or password. A candidate is validated by
its kind (Luhn sum, octets, area and group ranges, calendar); what fails stays as it is. A valid value becomes a list of
codes, each with its own radix; the list is split in halves, and ROUNDS times one half is shifted by a keystream that a
SHA-512 of key, kind, round and the other half gives, each code modulo its radix. That is a permutation of the values of
one format: equal values get equal pseudonyms in all documents, different ones different, and the result is valid again
(a card's last digit is the Luhn digit of the others). Separators, case and length stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31; 73049 = 17 x 4297.
FIRST_DAY, DAY_RADICES = "1900-01-01", (17, 4297)
#: The key of the registered query. A deployment passes its own.
DEMO_KEY = "pseudonym key of the registered query"


@dataclass(frozen=True)
class Kind:
    """A kind of value.

    pattern finds a candidate m in a text, shape tells from m alone that it is of this kind, and `value` is what of m is to
    be replaced, always a whole ending or, before `tail`, a beginning of it. valid, codes and radices are SQL over that
    value v, result is SQL over v and the new codes c."""

    name: str
    pattern: str
    shape: str
    valid: str
    codes: str
    radices: str
    result: str
    value: str = "m"


def _fill(codes: str) -> str:
    """v with its letters and digits in turn replaced by those of the codes: a digit by a digit, a letter by one of its case."""
    return (
        "aggregate(split(v, ''), named_struct('o', '', 'i', 0), (s, x) -> "
        f"CASE WHEN x RLIKE '[0-9]' THEN named_struct('o', s.o || string(get({codes}, s.i)), 'i', s.i + 1) "
        f"WHEN x RLIKE '[a-z]' THEN named_struct('o', s.o || char(97 + get({codes}, s.i)), 'i', s.i + 1) "
        f"WHEN x RLIKE '[A-Z]' THEN named_struct('o', s.o || char(65 + get({codes}, s.i)), 'i', s.i + 1) "
        "ELSE named_struct('o', s.o || x, 'i', s.i) END, s -> s.o)"
    )


def _let(value: str, name: str, body: str) -> str:
    """SQL for body, with a name for a value that it uses more than once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _luhn(numbers: str, odd: str) -> str:
    """Luhn sum of a list of digits modulo 10; `odd` says over i, the place from the right, which are doubled (1) or not (0)."""
    doubled = f"n * (1 + {odd}) - CASE WHEN n * (1 + {odd}) > 9 THEN 9 ELSE 0 END"
    return f"aggregate(transform(reverse({numbers}), (n, i) -> {doubled}), 0, (s, n) -> s + n) % 10"


_DIGITS = "transform(split(regexp_replace(v, '[^0-9]', ''), ''), x -> int(x))"
_ALNUM = "filter(split(v, ''), x -> x RLIKE '[0-9A-Za-z]')"
_CODES = f"transform({_ALNUM}, x -> CASE WHEN x RLIKE '[0-9]' THEN ascii(x) - 48 WHEN x RLIKE '[a-z]' THEN ascii(x) - 97 ELSE ascii(x) - 65 END)"
_RADICES = f"transform({_ALNUM}, x -> CASE WHEN x RLIKE '[0-9]' THEN 10 ELSE 26 END)"
_HEX = "(v RLIKE '^[0-9a-f]+$' OR v RLIKE '^[0-9A-F]+$')"
_OCTETS = "transform(split(v, '[.]'), x -> int(x))"


def _date(name: str, pattern: str, shape: str, iso: str, shown: str) -> Kind:
    """iso: v as year-month-day. What the calendar lacks, or lies outside the two centuries, isn't valid."""
    number = f"datediff(try_to_date({iso}, 'yyyy-MM-dd'), date'{FIRST_DAY}')"
    a, b = DAY_RADICES
    back = f"date_format(date_add(date'{FIRST_DAY}', int(c[0] * {b} + c[1])), '{shown}')"
    return Kind(name, pattern, shape, f"coalesce({number} BETWEEN 0 AND {a * b - 1}, false)", f"array(int({number} DIV {b}), int({number} % {b}))", f"array({a}, {b})", back)


#: In the order in which a candidate is tried.
KINDS = [
    Kind(
        "secret",
        r"(?i:token|secret|password|passwd|api[_-]?key)[\x22\x27]?\s{0,3}[=:]\s{0,3}[\x22\x27]?[A-Za-z0-9+/_-]{16,}+(?:[.][A-Za-z0-9+/_-]++)*+",
        r"^(?i:token|secret|password|passwd|api[_-]?key)[\x22\x27]?\s{0,3}[=:]",
        "true",
        f"CASE WHEN {_HEX} THEN transform(split(v, ''), x -> int(conv(x, 16, 10))) ELSE {_CODES} END",
        f"CASE WHEN {_HEX} THEN array_repeat(16, length(v)) ELSE {_RADICES} END",
        f"CASE WHEN v RLIKE '^[0-9a-f]+$' THEN array_join(transform(c, x -> lower(hex(x))), '') WHEN v RLIKE '^[0-9A-F]+$' THEN array_join(transform(c, x -> hex(x)), '') ELSE {_fill('c')} END",
        r"regexp_extract(m, r'[=:]\s*[\x22\x27]?([A-Za-z0-9+/_.-]+)$', 1)",
    ),
    Kind(
        "email",
        r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++)++",
        "@",
        "true",
        _CODES,
        _RADICES,
        _fill("c"),
        "substring_index(m, '@', 1)",
    ),
    Kind("ipv4", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", r"^(\d{1,3}\.){3}\d{1,3}$", f"forall({_OCTETS}, x -> x <= 255)", _OCTETS, "array(256, 256, 256, 256)", "array_join(c, '.')"),
    _date("date_iso", r"(?<![\w-])(?:19|20)\d\d-[01]\d-[0-3]\d(?![\w-])", r"^\d{4}-\d\d-\d\d$", "v", "yyyy-MM-dd"),
    _date("date_dots", r"(?<![\w.])[0-3]\d\.[01]\d\.(?:19|20)\d\d(?![\w]|\.\d)", r"^\d\d\.\d\d\.\d{4}$", "concat_ws('-', substr(v, 7, 4), substr(v, 4, 2), substr(v, 1, 2))", "dd.MM.yyyy"),
    _date("date_slashes", r"(?<![\w/])[01]\d/[0-3]\d/(?:19|20)\d\d(?![\w/])", r"^\d\d/\d\d/\d{4}$", "concat_ws('-', substr(v, 7, 4), substr(v, 1, 2), substr(v, 4, 2))", "MM/dd/yyyy"),
    Kind(
        "ssn",
        r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])",
        r"^\d{3}-\d\d-\d{4}$",
        "int(substr(v, 1, 3)) BETWEEN 1 AND 899 AND int(substr(v, 1, 3)) <> 666 AND substr(v, 5, 2) <> '00' AND substr(v, 8) <> '0000'",
        "array(int(substr(v, 1, 3)) - CASE WHEN int(substr(v, 1, 3)) > 666 THEN 2 ELSE 1 END, int(substr(v, 5, 2)) - 1, int(substr(v, 8)) - 1)",
        "array(898, 99, 9999)",
        "format_string('%03d-%02d-%04d', c[0] + CASE WHEN c[0] >= 665 THEN 2 ELSE 1 END, c[1] + 1, c[2] + 1)",
    ),
    Kind(
        "phone",
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\w-])",
        r"[(]?\d{3}[) .-]{1,2}\d{3}[ .-]\d{4}$",
        "true",
        _DIGITS,
        "array_repeat(10, 10)",
        _fill("c"),
        r"regexp_extract(m, r'[(]?\d{3}[) .-]{1,2}\d{3}[ .-]\d{4}$', 0)",  # a country code stays
    ),
    Kind(
        "card",
        r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)",
        r"^[0-9 -]{13,}$",
        _luhn(_DIGITS, "i % 2") + " = 0",
        f"slice({_DIGITS}, 1, size({_DIGITS}) - 1)",
        f"array_repeat(10, size({_DIGITS}) - 1)",
        _let("array_append(c, int((10 - " + _luhn("c", "(i + 1) % 2") + ") % 10))", "d", _fill("d")),
    ),
]

PATTERN = "|".join(k.pattern for k in KINDS)


def _raw(text: str) -> str:
    """A raw SQL string; patterns name quotes by their codes."""
    assert "'" not in text and '"' not in text
    return f"r'{text}'"


def permuted(codes: str, radices: str, tweak: str, key: str, rounds: int = ROUNDS) -> str:
    """SQL for the codes after the Feistel rounds."""
    key = key.encode().hex()

    def shifted(half: str, other: str, radix: str) -> str:
        # four hexadecimal digits for each code, so 32 codes a digest
        block = f"sha2(concat_ws('|', '{key}', '{tweak}', string(k), string(size({half})), array_join({other}, ','), string(b)), 512)"
        stream = f"array_join(transform(sequence(0, (size({half}) - 1) DIV 32), b -> {block}), '')"
        return _let(stream, "z", f"transform({half}, (x, j) -> int(pmod(x + bigint(conv(substr(z, 4 * j + 1, 4), 16, 10)), {radix}[j])))")

    struct = "named_struct('a', {}, 'b', {}, 'ra', t.ra, 'rb', t.rb)"
    step = f"CASE WHEN k % 2 = 0 AND size(t.a) > 0 THEN {struct.format(shifted('t.a', 't.b', 't.ra'), 't.b')} WHEN k % 2 = 1 THEN {struct.format('t.a', shifted('t.b', 't.a', 't.rb'))} ELSE t END"
    cut = "size(w.c) DIV 2"
    start = f"named_struct('a', slice(w.c, 1, {cut}), 'b', slice(w.c, {cut} + 1, size(w.c)), 'ra', slice(w.r, 1, {cut}), 'rb', slice(w.r, {cut} + 1, size(w.c)))"
    return _let(f"named_struct('c', {codes}, 'r', {radices})", "w", f"aggregate(sequence(0, {rounds - 1}), {start}, (t, k) -> {step}, t -> concat(t.a, t.b))")


def pseudonym(key: str) -> str:
    """SQL of the pseudonym of m, a candidate; null where its kind doesn't find it valid."""
    cases = []
    for kind in KINDS:
        new = _let(permuted(kind.codes, kind.radices, kind.name, key), "c", kind.result)
        if kind.name == "email":
            new = f"{new} || substr(m, length(v) + 1)"
        elif kind.value != "m":
            new = f"substr(m, 1, length(m) - length(v)) || {new}"
        cases.append(f"WHEN m RLIKE {_raw(kind.shape)} THEN " + _let(kind.value, "v", f"CASE WHEN {kind.valid} THEN {new} END"))
    return "CASE " + " ".join(cases) + " END"


def pseudonymise(docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id_column, text with pseudonyms, n_replaced.

    A null text stays null and counts none; an empty text stays empty. Rows don't depend on each other, so repeated rows get
    equal results; other columns don't matter."""
    found = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).withColumn("found", F.expr(f"regexp_extract_all(text, {_raw(PATTERN)}, 0)"))
    # null where a candidate isn't valid
    found = found.withColumn("new", F.when(F.size("found") > 0, F.expr(f"transform(found, m -> {pseudonym(key)})")))
    pieces = F.expr(f"split(text, {_raw(PATTERN)}, -1)")
    joined = F.expr("array_join(zip_with(pieces, transform(new, (n, i) -> coalesce(n, found[i])), (p, n) -> p || coalesce(n, '')), '')")
    changed = F.expr("size(filter(new, n -> n IS NOT NULL))")
    out = found.withColumn("n_replaced", F.when(F.col("new").isNull(), 0).otherwise(changed).cast("long"))
    out = out.withColumn("pieces", F.when(F.col("n_replaced") > 0, pieces))
    return out.select(F.col("id").alias(id_column), F.when(F.col("n_replaced") > 0, joined).otherwise(F.col("text")).alias(text), "n_replaced")
