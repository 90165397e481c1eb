"""Personal data replaced by format-preserving pseudonyms, with DataFrame functions only.

One pattern finds the candidates and each is validated for what it may be: a card number by its
check digit, an account number by its remainder, a date by the calendar, an address by
its octets. A candidate that is not valid as a whole is searched for valid parts between its
groups, from each start the longest first. A valid value is permuted under a key within the values of its format by a
Feistel network on its digits; where the result is not valid, it is permuted again until it is
(cycle walking), so the map stays one to one. Equal values get equal pseudonyms in
all documents, however they are spaced, and check digits are made anew. E-mail addresses,
which have no format to keep, get a keyed name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnfold.llm.common import fresh

KINDS = ("email", "date", "iban", "ip", "card", "ssn", "phone")
ROUNDS = 8
WALKS = 40
_FIRST_DAY, _DAYS = "1900-01-01", 73_049
# the other days that the patterns match, a domain of their own
_EARLY, _LATE = "1000-01-01", "2100-01-01"
_EARLY_DAYS, _OTHER_DAYS = 328_718, 657_436
# Groups that a valid value can have, and groups of a run that are searched in one go.
GROUPS, STRETCH = 19, 256

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
ISO_DATE = r"(?<![0-9.\-])[12][0-9]{3}-[0-9]{2}-[0-9]{2}(?![0-9])(?!-[0-9])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[12][0-9]{3}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])(?!-[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+.\-])(?:\+[0-9]{1,3}[ .\-])?[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){3,4}(?![0-9])"
)
# Runs may be longer than what is valid; parts of them are tried. They are taken group by group and never given
# back (possessive), since the engine would need a stack frame for every group it might give back.
_CARD_RUN = r"(?<![0-9A-Za-z])(?=[0-9](?:[ \-]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ \-][0-9]++(?![A-Za-z]))*+"
_IBAN_RUN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2})[A-Z0-9]++(?![a-z@])(?: [A-Z0-9]++(?![a-z@]))*+"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, ISO_DATE, DAY_DATE, _IBAN_RUN, IP, SSN, PHONE, _CARD_RUN))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _keyed(key: str, *parts: Column) -> Column:
    """A number below 2**60 from a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(digits: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the digit strings of each length (2 to 36), leading zeros included."""
    n = F.char_length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    start = F.struct(
        F.substring(digits, F.lit(1), left).cast("decimal(18,0)").cast("long").alias("a"),
        F.substring(digits, left + 1, right).cast("decimal(18,0)").cast("long").alias("b"),
    )

    def turn(state: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, left).otherwise(right)
        modulus = F.rpad(F.lit("1"), size + 1, "0").cast("long")
        moved = _keyed(key, F.lit(kind), n.cast("string"), i.cast("string"), state.b.cast("string"))
        return F.struct(state.b.alias("a"), F.pmod(state.a + F.pmod(moved, modulus), modulus).alias("b"))

    def joined(state: Column) -> Column:
        return F.concat(F.lpad(state.a.cast("string"), left, "0"), F.lpad(state.b.cast("string"), right, "0"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, joined)


def walk(digits: Column, key: str, kind: str, valid) -> Column:
    """The permutation applied until ``valid`` holds again; valid values map one to one onto valid values."""
    once = feistel(digits, key, kind)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), once, lambda state, _: F.when(valid(state), state).otherwise(feistel(state, key, kind))
    )


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced one by one; everything else stays."""
    each = F.transform(
        F.sequence(F.lit(1), F.char_length(shape)),
        lambda i: F.when(
            F.substring(shape, i, F.lit(1)).rlike("[0-9]"),
            F.substring(digits, F.char_length(_digits(F.substring(shape, F.lit(1), i))), F.lit(1)),
        ).otherwise(F.substring(shape, i, F.lit(1))),
    )
    return F.array_join(each, "")


def luhn_sum(digits: Column) -> Column:
    """Weighted sum of the digits, the last one counted once; a multiple of 10 for a valid number."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(account: Column) -> Column:
    """Remainder of an account number by its standard: the first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(account, F.lit(5), F.char_length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add)


def _ip_permuted(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    start = F.struct((octets[0] * 256 + octets[1]).alias("a"), (octets[2] * 256 + octets[3]).alias("b"))

    def turn(state: Column, i: Column) -> Column:
        moved = F.pmod(_keyed(key, F.lit("ip"), i.cast("string"), state.b.cast("string")), F.lit(65536)).cast("int")
        return F.struct(state.b.alias("a"), F.pmod(state.a + moved, F.lit(65536)).alias("b"))

    def joined(state: Column) -> Column:
        part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return F.concat_ws(".", part(state.a), part(state.b))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, joined)


def _day(value: Column) -> Column:
    iso = F.try_to_date(value, "yyyy-MM-dd")
    local = F.try_to_date(F.replace(value, F.lit("/"), F.lit(".")), "dd.MM.yyyy")
    return F.when(value.rlike("^[0-9]{4}-"), iso).otherwise(local)


def _index(value: Column) -> Column:
    return F.datediff(_day(value), F.lit(_FIRST_DAY).cast("date"))


def _date_permuted(value: Column, key: str) -> Column:
    index, first = _index(value), lambda day: F.lit(day).cast("date")
    moved = walk(F.lpad(index.cast("string"), 5, "0"), key, "date", lambda d: d.cast("int") < _DAYS).cast("int")
    other = F.when(index < 0, F.datediff(_day(value), first(_EARLY))).otherwise(F.datediff(_day(value), first(_LATE)) + _EARLY_DAYS)
    other = walk(F.lpad(other.cast("string"), 6, "0"), key, "other date", lambda d: d.cast("int") < _OTHER_DAYS).cast("int")
    far = F.when(other < _EARLY_DAYS, F.date_add(first(_EARLY), other)).otherwise(F.date_add(first(_LATE), other - _EARLY_DAYS))
    day = F.when((index >= 0) & (index < _DAYS), F.date_add(first(_FIRST_DAY), moved)).otherwise(far)
    local = F.date_format(day, "dd.MM.yyyy")
    return F.when(value.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd")).when(
        value.contains("/"), F.replace(local, F.lit("."), F.lit("/"))
    ).otherwise(local)


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(value: Column) -> Column:
    """What a candidate is, or NULL if it is not valid as anything."""
    digits, compact = _digits(value), F.replace(value, F.lit(" "), F.lit(""))
    octets = F.split(value, r"\.")
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(_whole(ISO_DATE)) | value.rlike(_whole(DAY_DATE)), F.when(_day(value).isNotNull(), "date"))
        .when(value.rlike("^[A-Z]"), F.when(value.rlike(_whole(IBAN)) & (mod97(compact) == 1), "iban"))
        .when(value.rlike(_whole(IP)), F.when(F.forall(octets, lambda x: x.cast("int") <= 255), "ip"))
        .when(value.rlike(_whole(SSN)), F.when(_ssn_valid(digits), "ssn"))
        .when(value.rlike(_whole(CARD)) & (luhn_sum(digits) % 10 == 0), "card")
        .when(value.rlike(_whole(PHONE)) & F.char_length(digits).between(9, 15), "phone")
    )


def parts_of(value: Column) -> Column:
    """A candidate in pieces (kind, value) that make it up; kind is NULL for what is not personal.

    A candidate that is not valid as a whole is searched group by group, each start with the ``GROUPS`` groups from
    it on. The pieces are gathered by stretches of groups, so that the work is in proportion to the length.
    """
    bind = lambda column, body: F.get(F.transform(F.array(column), body), F.lit(0))

    def searched(groups: Column) -> Column:
        n = F.size(groups)
        begin = F.struct(F.lit(1).alias("next"), F.array().cast(_PIECES).alias("out"))

        def stretch(state: Column, k: Column) -> Column:
            numbers = F.sequence(k * STRETCH + 1, F.least((k + 1) * STRETCH, n))
            inner = F.aggregate(numbers, begin.withField("next", state["next"]), lambda s, i: _step(groups, n, s, i))
            return bind(inner, lambda x: F.struct(x["next"].alias("next"), F.array_append(state["out"], x["out"]).alias("out")))

        start = F.struct(F.lit(1).alias("next"), F.array().cast(f"array<{_PIECES}>").alias("out"))
        last = F.floor((n - 1) / STRETCH).cast("int")
        return F.aggregate(F.sequence(F.lit(0), last), start, stretch, lambda state: F.flatten(state["out"]))

    whole = F.array(F.struct(kind_of(value).alias("kind"), value.alias("value")))
    parted = value.rlike(r"[ \-][A-Za-z0-9]")
    # each is bound to a name, so that it is computed once and not wherever it is used
    return bind(
        whole, lambda w: F.when(F.get(w, F.lit(0))["kind"].isNull() & parted, bind(F.split(value, r"(?<=[ \-])"), searched)).otherwise(w)
    )


_PIECES = "array<struct<kind: string, value: string>>"


def _step(groups: Column, n: Column, state: Column, i: Column) -> Column:
    """One group on: the longest valid part from group ``i``, or the group as it is; nothing inside a part that was taken."""
    piece = lambda kind, text: F.struct(kind.cast("string").alias("kind"), text.alias("value"))

    def chosen(best: Column) -> Column:
        rest = F.substring(best["text"], F.char_length(best["core"]) + 1, F.lit(1))
        return F.when(
            best.isNull(), F.struct((i + 1).alias("next"), F.array_append(state["out"], piece(F.lit(None), F.get(groups, i - 1))).alias("out"))
        ).otherwise(
            F.struct(
                (best["j"] + 1).alias("next"),
                F.concat(state["out"], F.array(piece(best["kind"], best["core"]), piece(F.lit(None), rest))).alias("out"),
            )
        )

    return F.when(i < state["next"], state).otherwise(F.get(F.transform(F.array(F.get(_spans(groups, n, i), F.lit(0))), chosen), F.lit(0)))


def _spans(groups: Column, n: Column, i: Column) -> Column:
    """Valid parts from group ``i`` on, the longest first."""
    each = F.transform(
        F.sequence(F.least(i + GROUPS - 1, n), i, F.lit(-1)),
        lambda j: F.struct(j.alias("j"), F.array_join(F.slice(groups, i, j - i + 1), "").alias("text")),
    )
    each = F.transform(each, lambda x: F.struct(x["j"].alias("j"), x["text"].alias("text"), F.regexp_replace(x["text"], r"[ \-]$", "").alias("core")))
    each = F.filter(each, lambda x: F.char_length(x["core"]).between(8, 45))
    each = F.transform(each, lambda x: x.withField("kind", kind_of(x["core"])))
    # other kinds do not begin or end at a hyphen
    apart = lambda x: ~x["text"].endswith("-") & ((i == 1) | ~F.get(groups, i - 2).endswith("-"))
    return F.filter(each, lambda x: x["kind"].isin("card", "iban") | (x["kind"].isNotNull() & apart(x)))


def _ssn_valid(digits: Column) -> Column:
    return digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym in the same format; ``value`` itself where ``kind`` is NULL."""
    digits, compact = _digits(value), F.replace(value, F.lit(" "), F.lit(""))
    body = feistel(F.substring(digits, F.lit(1), F.char_length(digits) - 1), key, "card")
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    rest = F.substring(compact, F.lit(5), F.char_length(compact))
    account = F.when(F.char_length(_digits(rest)) >= 2, _refill(rest, feistel(_digits(rest), key, "iban"))).otherwise(rest)
    country = F.substring(compact, 1, 2)
    control = F.lpad((98 - mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    permuted_account = F.concat(country, control, account)
    spaced = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.char_length(value)),
            lambda i: F.when(F.substring(value, i, F.lit(1)) == " ", " ").otherwise(
                F.substring(permuted_account, F.char_length(F.replace(F.substring(value, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1))
            ),
        ),
        "",
    )
    local = F.right(digits, F.lit(10))
    nanp = walk(local, key, "phone", lambda d: d.rlike("^[2-9][0-9]{2}[2-9]"))
    phone = F.when(
        (F.char_length(digits) >= 10) & local.rlike("^[2-9][0-9]{2}[2-9]"),
        _refill(value, F.concat(F.substring(digits, F.lit(1), F.char_length(digits) - 10), nanp)),
    ).otherwise(
        _refill(value, F.concat(F.substring(digits, 1, 2), feistel(F.substring(digits, F.lit(3), F.char_length(digits)), key, "phone")))
    )
    name = F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 16)
    return (
        F.when(kind == "email", F.concat(F.lit("u"), name, F.lit("@example.org")))
        .when(kind == "date", _date_permuted(value, key))
        .when(kind == "iban", spaced)
        .when(kind == "ip", _ip_permuted(value, key))
        .when(kind == "ssn", _refill(value, walk(digits, key, "ssn", _ssn_valid)))
        .when(kind == "card", _refill(value, F.concat(body, check.cast("string"))))
        .when(kind == "phone", phone)
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "found") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``found``: kind and pseudonym of each.

    NULL texts stay NULL and have an empty array, as have empty texts. All rows and other
    columns stay; a column already called ``found`` is replaced. ``key`` is a secret.
    """
    parts = fresh(docs, "_parts")
    candidates = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    replaced = F.transform(candidates, lambda v: F.transform(
        parts_of(v), lambda c: F.struct(c["kind"].alias("kind"), pseudonym(c["value"], c["kind"], key).alias("value"))
    ))
    may = F.col(text).rlike("[0-9@]")
    out = docs.withColumn(parts, F.when(may, replaced))
    tail = F.array(F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("value"))))
    filled = F.array_join(
        F.zip_with(F.split(F.col(text), ANY, -1), F.concat(F.col(parts), tail), lambda gap, p: F.concat(gap, F.array_join(F.transform(p, lambda x: x["value"]), ""))), ""
    )
    some = F.size(F.coalesce(F.col(parts), F.array())) > 0
    return (
        out.withColumn(text, F.when(some, filled).otherwise(F.col(text)))
        .withColumn(found, F.coalesce(F.filter(F.flatten(parts), lambda p: p["kind"].isNotNull()), F.array().cast("array<struct<kind: string, value: string>>")))
        .drop(parts)
    )
