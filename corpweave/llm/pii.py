"""Format-preserving pseudonyms for personal data, with DataFrame and SQL functions only.

A text is split at what looks like an e-mail address, IPv4 address, date, IBAN, card, social-security or phone number.
What also passes that kind's validation is permuted within its format by a keyed Feistel network; equal values get
equal pseudonyms in all documents, and different ones different pseudonyms. The symbols of a value (digits, letters,
octets, a date's day number in two places) form two halves; in each round every symbol of one half is moved, within its
own radix, by a keyed hash of the other half. Check digits are made anew, so that a pseudonym passes the same
validation. Dates from 1900 to 2101 stay among themselves, and so do all others. A date with slashes is read month first
where that is a date; those that can only be read day first stay among themselves too, by walking the cycle
until the pseudonym can't be read month first either.

The key never enters a plan: the driver derives one for each kind from it by HMAC, and a scalar subquery over a table of
one row hands those to the expressions, so that plans, event logs and the UI show names alone.

Defined results: a null text stays null; a text without findings stays as it is; what fails validation stays; a value
that repeats gets one pseudonym everywhere; of a card number or IBAN with something like further digits after a space
the longest valid part is replaced; an empty table gives no rows; other columns pass through. Long runs
without a finding are read once, since no pattern backtracks over them.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 on that dates are permuted in (SIDE squared), the number of that day from 0001-01-01, and the number of all days up to 9999.
SIDE, FIRST, DAYS = 271, 693595, 3652059
#: Places of a day number among all days: a little more than there are.
SIDES = (1911, 1912)
#: Steps of a cycle that are walked at most; three of five end it, so that it would take 10^50 dates to see one that takes them all.
WALK = 128

#: Fixed patterns, by kind; the first that fits wins. Each is (what may not stand before, the value, what may not follow).
PATTERNS = {
    "email": [(r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}", r"[A-Za-z0-9]")],
    "ipv4": [(r"[\w.]", r"(?:\d{1,3}\.){3}\d{1,3}", r"\.?\w")],
    "iso_date": [(r"[\w-]", r"\d{4}-\d{2}-\d{2}", r"(?!T\d)[\w-]")],
    "dot_date": [(r"[\w.]", r"\d{2}\.\d{2}\.\d{4}", r"\.?\w")],
    "slash_date": [(r"[\w/]", r"\d{2}/\d{2}/\d{4}", r"[\w/]")],
    "iban": [(r"\w", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"\w")],
    "ssn": [(r"[\w-]", r"\d{3}-\d{2}-\d{4}", r"[\w-]")],
    "card": [(r"[\w.+-]", r"\d(?:[ -]?\d){12,18}", r"[\w-]")],
    "phone": [
        (r"[\w+]", r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}", r"\w"),
        (r"[\w+]", r"\+[2-9]\d{0,2}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}", r"\w"),
        (r"[\w(]", r"\(\d{3}\) ?\d{3}[ .-]\d{4}", r"\w"),
        (r"[\w.-]", r"\d{3}[.-]\d{3}[.-]\d{4}", r"[\w-]"),
    ],
}
#: No pattern fits a text without one of these.
HINT = "[0-9@]"


def derived(key: str, kind: str) -> str:
    """The key of one kind of value."""
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()


def key_column(spark: SparkSession, key: str) -> Column:
    """A struct of the keys of all kinds, with no value of theirs in the plan."""
    kinds = ["date", *(k for k in PATTERNS if not k.endswith("_date"))]
    one = spark.createDataFrame([tuple(derived(key, k) for k in kinds)], ", ".join(f"{k} string" for k in kinds))
    return one.select(F.struct(*kinds)).scalar()


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def permuted(values: str, radices: str, key: str, tag: str, rounds: int = ROUNDS) -> str:
    """SQL for an array of integers permuted within its radices; the halves are the even and the odd places.

    ``key`` is SQL for the kind's key."""
    other = "array_join(transform(v, (y, j) -> if(j % 2 != r % 2, cast(y as string), '')), ',')"
    moved = f"cast(conv(substr(sha2(concat_ws('|', {key}, {_sql(tag)}, r, i, h), 256), 1, 12), 16, 10) as bigint)"
    step = f"transform(v, (x, i) -> if(i % 2 = r % 2, (x + {moved}) % element_at(rad, i + 1), x))"
    # the inner transform binds the other half once for each round
    step = f"element_at(transform(array({other}), h -> {step}), 1)"
    return f"element_at(transform(array({radices}), rad -> aggregate(sequence(0, {rounds - 1}), {values}, (v, r) -> {step})), 1)"


_CHARS = "split({0}, '')"
#: Class of a character: value, radix and first code; other characters have radix 1.
_VALUE = "case when c between '0' and '9' then ascii(c) - 48 when c between 'a' and 'z' then ascii(c) - 97 when c between 'A' and 'Z' then ascii(c) - 65 else 0 end"
_RADIX = "case when c between '0' and '9' then 10 when c between 'a' and 'z' then 26 when c between 'A' and 'Z' then 26 else 1 end"
_BACK = "case when c between '0' and '9' then char(48 + x) when c between 'a' and 'z' then char(97 + x) when c between 'A' and 'Z' then char(65 + x) else c end"


def _spelled(text: str, key: str, tag: str) -> str:
    """SQL for a text whose digits and letters are permuted within their classes."""
    chars = _CHARS.format(text)
    new = permuted(f"transform({chars}, c -> cast({_VALUE} as bigint))", f"transform({chars}, c -> {_RADIX})", key, tag)
    return f"if({text} = '', '', array_join(zip_with({chars}, {new}, (c, x) -> {_BACK}), ''))"


def _digits(text: str, kept: int, key: str, tag: str) -> str:
    """SQL for a string of digits whose places after the first ``kept`` are permuted."""
    tail = f"split(substr({text}, {kept + 1}), '')"
    new = permuted(f"transform({tail}, c -> cast(c as bigint))", f"transform({tail}, c -> 10)", key, tag)
    return f"concat(substr({text}, 1, {kept}), array_join({new}, ''))"


def _luhn(digits: str) -> str:
    """SQL for the Luhn sum modulo ten of a string of digits."""
    part = "if(i % 2 = 1, if(c > 4, 2 * c - 9, 2 * c), c)"
    return f"aggregate(transform(transform(split(reverse({digits}), ''), c -> cast(c as int)), (c, i) -> {part}), 0, (s, x) -> s + x) % 10"


def _laid_out(layout: str, symbols: str) -> str:
    """SQL for ``symbols`` (a string) put one by one in the places of the digits and capitals of ``layout``."""
    chars = _CHARS.format(layout)
    place = f"transform({chars}, (c, i) -> size(filter(slice({chars}, 1, i + 1), d -> d rlike '[0-9A-Z]')))"
    return f"array_join(zip_with({chars}, {place}, (c, n) -> if(c rlike '[0-9A-Z]', substr({symbols}, n, 1), c)), '')"


def _mod97(text: str) -> str:
    """SQL for an IBAN without spaces, its first four characters moved to the end and letters spelled as numbers, modulo 97."""
    chars = f"split(concat(substr({text}, 5), substr({text}, 1, 4)), '')"
    return f"aggregate({chars}, 0, (s, c) -> if(c between '0' and '9', s * 10 + ascii(c) - 48, s * 100 + ascii(c) - 55) % 97)"


def _bound(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value`` once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _longest(m: str, least: int, valid: str, new: str) -> tuple[str, str]:
    """SQL for (whether a part of ``m`` from its start to a space, hyphen or the end is valid, ``m`` with the longest such part replaced).

    ``valid`` and ``new`` are SQL on the part, which they call q."""
    parts = f"transform(filter(sequence(length({m}), least({least}, length({m})), -1), n -> n = length({m}) or substr({m}, n + 1, 1) in (' ', '-')), n -> substr({m}, 1, n))"
    good = f"filter({parts}, q -> {valid})"
    return f"size({good}) > 0", _bound(f"{good}[0]", "q", f"concat({new}, substr({m}, length(q) + 1))")


def pseudonym(kind: str, m: str, key: str) -> tuple[str, str]:
    """SQL for (whether ``m`` is valid, its pseudonym) of a kind; ``m`` is the name of what was found, ``key`` SQL for the kind's key."""
    if kind == "email":
        cut = f"length({m}) - instr(reverse({m}), '.')"
        return "true", f"concat({_spelled(f'substr({m}, 1, {cut})', key, kind)}, substr({m}, {cut} + 1))"
    if kind == "ipv4":
        octets = f"transform(split({m}, '[.]'), c -> cast(c as bigint))"
        return f"forall({octets}, x -> x < 256)", f"array_join({permuted(octets, 'array(256, 256, 256, 256)', key, kind)}, '.')"
    if kind.endswith("_date"):
        form = {"iso_date": "yyyy-MM-dd", "dot_date": "dd.MM.yyyy", "slash_date": "MM/dd/yyyy"}[kind]
        forms = [form, "dd/MM/yyyy"] if kind == "slash_date" else [form]

        def day(f: str) -> str:
            y, mo, d = (f"substr({m}, {f.index(x) + 1}, {len(x)})" for x in ("yyyy", "MM", "dd"))
            return f"if({y} = '0000', null, datediff(try_cast(concat({y}, '-', {mo}, '-', {d}) as date), date'0001-01-01'))"

        def late(n: str) -> str:
            return f"{n} between {FIRST} and {FIRST + SIDE * SIDE - 1}"

        def step(n: str, near: bool) -> str:
            a, b, base = (SIDE, SIDE, FIRST) if near else (*SIDES, 0)
            moved = permuted(f"array(cast(({n} - {base}) div {b} as bigint), cast(({n} - {base}) % {b} as bigint))", f"array({a}, {b})", key, "date")
            return _bound(moved, "p", f"p[0] * {b} + p[1] + {base}")

        def walked(n: str, near: bool, only_day_first: bool) -> str:
            ends = [] if near else [f"w < {DAYS}", f"not ({late('w')})"]
            ends += ["day(date_add(date'0001-01-01', cast(w as int))) > 12"] if only_day_first else []
            first = step(n, near)
            return f"aggregate(sequence(1, {WALK}), {first}, (w, u) -> if({' and '.join(ends)}, w, {step('w', near)}))" if ends else first

        def new(f: str) -> str:
            only = f == "dd/MM/yyyy"
            return _bound(_bound(day(f), "n", f"if({late('n')}, {walked('n', True, only)}, {walked('n', False, only)})"), "z", f"date_format(date_add(date'0001-01-01', cast(z as int)), '{f}')")

        out = new(forms[-1])
        for f in forms[-2::-1]:
            out = f"if({day(f)} is not null, {new(f)}, {out})"
        return " or ".join(f"{day(f)} is not null" for f in forms), out
    if kind == "iban":
        body = _spelled("substr(t, 5)", key, kind)
        check = _bound(body, "b", f"concat(substr(t, 1, 2), lpad(cast(98 - {_mod97('concat(substr(t, 1, 2), ' + repr('00') + ', b)')} as string), 2, '0'), b)")
        valid = _bound("replace(q, ' ', '')", "t", f"length(t) between 15 and 34 and {_mod97('t')} = 1")
        return _longest(m, 15, valid, _bound(_bound("replace(q, ' ', '')", "t", check), "z", _laid_out("q", "z")))
    if kind == "ssn":
        area, group, serial = (f"cast(substr({m}, {a}, {n}) as bigint)" for a, n in ((1, 3), (5, 2), (8, 4)))
        place = f"array(if({area} > 666, {area} - 2, {area} - 1), {group} - 1, {serial} - 1)"
        new = permuted(place, "array(898, 99, 9999)", key, kind)
        return f"{area} between 1 and 899 and {area} != 666 and {group} > 0 and {serial} > 0", _bound(new, "p", "concat_ws('-', lpad(cast(if(p[0] >= 665, p[0] + 2, p[0] + 1) as string), 3, '0'), lpad(cast(p[1] + 1 as string), 2, '0'), lpad(cast(p[2] + 1 as string), 4, '0'))")
    if kind == "card":
        head = _digits("substr(t, 1, length(t) - 1)", 1, key, kind)
        whole = _bound(head, "b", f"concat(b, cast((10 - {_luhn('concat(b, ' + repr('0') + ')')}) % 10 as string))")
        valid = _bound("translate(q, ' -', '')", "t", f"length(t) between 13 and 19 and {_luhn('t')} = 0 and t not rlike '^0'")
        return _longest(m, 13, valid, _bound(_bound("translate(q, ' -', '')", "t", whole), "z", _laid_out("q", "z")))
    if kind == "phone":
        # a country code stays; a digit from 2 to 9 stays one, so area codes remain valid
        code = f"if({m} like '+1%', 2, length(regexp_extract({m}, '^[+][0-9]{{1,3}}(?![0-9])', 0)))"
        head, tail = f"substr({m}, 1, {code})", f"substr({m}, {code} + 1)"
        chars = _CHARS.format("t")
        value = "case when c between '2' and '9' then ascii(c) - 50 when c between '0' and '1' then ascii(c) - 48 else 0 end"
        radix = "case when c between '2' and '9' then 8 when c between '0' and '1' then 2 else 1 end"
        back = "case when c between '2' and '9' then char(50 + x) when c between '0' and '1' then char(48 + x) else c end"
        new = permuted(f"transform({chars}, c -> cast({value} as bigint))", f"transform({chars}, c -> {radix})", key, kind)
        return f"length(regexp_replace({m}, '[^0-9]', '')) between 7 and 15", f"concat({head}, {_bound(tail, 't', f'array_join(zip_with({chars}, {new}, (c, x) -> {back}), {repr(str())})')})"
    raise ValueError(kind)


def pattern_of(kinds: list[str]) -> str:
    """One pattern for what looks like a value of these kinds."""
    return "|".join(f"(?<!{before}){value}(?!{after})" for k in kinds for before, value, after in PATTERNS[k])


def whole_of(kind: str) -> str:
    """The pattern of a kind for one finding."""
    return f"^(?:{'|'.join(value for _, value, _ in PATTERNS[kind])})$"


def found(name: str, keys: str, kinds: list[str] | None = None) -> Column:
    """An array of (kind, value, pseudonym) in a text column, in its order; what is not valid has no kind and stays as it is.

    ``keys`` is the name of a column that ``key_column`` gives."""
    kinds = kinds or list(PATTERNS)
    pattern = pattern_of(kinds)
    cases, news = [], []
    for k in kinds:
        valid, new = pseudonym(k, "m", f"{keys}.{'date' if k.endswith('_date') else k}")
        cases.append(f"when m rlike {_sql(whole_of(k))} and ({valid}) then {_sql(k)}")
        news.append(f"when {_sql(k)} then {new}")
    kind = f"case {' '.join(cases)} end"
    one = f"transform(array({kind}), k -> named_struct('kind', k, 'value', m, 'pseudonym', case k {' '.join(news)} else m end))[0]"
    return F.expr(f"transform(if({name} rlike {_sql(HINT)}, regexp_extract_all({name}, {_sql(pattern)}, 0), cast(array() as array<string>)), m -> {one})")


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", findings_col: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The documents with pseudonyms in the text; with ``findings_col``, also an array of (kind, value, pseudonym, start).

    Starts are those of the original text, in characters from one."""
    kinds = kinds or list(PATTERNS)
    pattern = _sql(pattern_of(kinds))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    t = f"c{docs.columns.index(text_col)}"
    rows = plain.withColumn("keys", key_column(docs.sparkSession, key)).withColumn("f", found(t, "keys", kinds))
    # all between the findings, one piece more than there are findings
    rows = rows.withColumn("p", F.expr(f"if(size(f) > 0, split({t}, {pattern}, -1), cast(array() as array<string>))"))
    text = F.expr(f"if(size(f) > 0, concat_ws('', flatten(zip_with(p, f.pseudonym, (a, b) -> array(a, coalesce(b, ''))))), {t})")
    out = [text.alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    if findings_col:
        start = "aggregate(slice(zip_with(p, f.value, (a, b) -> length(a) + coalesce(length(b), 0)), 1, i), 0, (s, n) -> s + n) + length(p[i]) + 1"
        out.append(F.expr(f"filter(transform(coalesce(f, cast(array() as array<struct<kind:string,value:string,pseudonym:string>>)), (x, i) -> named_struct('kind', x.kind, 'value', x.value, 'pseudonym', x.pseudonym, 'start', {start})), x -> x.kind is not null)").alias(findings_col))
    return rows.select(*out)
