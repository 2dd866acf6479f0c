"""Personal data: format-preserving Feistel pseudonyms (DataFrame functions only).

Numbers and dates that pass their check, and the variable part of e-mail addresses and keys, are
permuted by a keyed Feistel network inside their own format: digits stay digits, a card keeps its
length and separators and a right check digit, an IBAN its country and right check digits, a date
stays a date in the same notation.  The permutation is a bijection of each format, so equal values
get equal pseudonyms in every document (links survive) and different values stay different.

Found kinds, in order of the pattern:

=========  =============================================  =======================================
kind       value, with its check                          pseudonym
=========  =============================================  =======================================
email      local part and domain                          letters and digits of both sides (but the
                                                          last label) permuted in their classes
secret     key/token/secret/password = value, any length, hexadecimal or letters/digits permuted
           dot-joined parts too; quoted, a password=, or
           with a digit, mixed case, padding or hexadecimal
iban       its country's length (any other code: 15-34),  digits permuted, check digits anew
           remainder 1 modulo 97
date       1800-2199, day exists (y-m-d, d.m.y, y/m/d,    another day in the same notation
           d/m/y, and m/d/y where the day is above 12)
ip         four octets up to 255                          32 bits permuted
ssn        3-2-4 digits                                   digits permuted
card       13-19 digits, Luhn                             digits permuted, check digit anew
phone      + or (area), three groups, or two with a zero  digits after the country code or zero permuted
           or 3-7 and 3-8 digits; no thousands, years, ISBN
=========  =============================================  =======================================

Values that fail their check stay as they are.  Where a short token follows a card or an IBAN, the check
decides where the value ends: the longest reading that passes is taken, the rest stays.  A pseudonym
that would be read with another end is permuted again (cycle-walking), so that it can be undone.  A digit string is permuted as the two halves of a
Feistel network over Z/10^a x Z/10^b (additions instead of exclusive or), which needs no walking;
days are numbered in the 400-year cycle of the calendar, 146097 = 189 * 773 days.

Round values are 64-bit hashes of key, kind, round and half.  Change ``key`` for every release; who
holds it can undo the pseudonyms (``decrypt=True`` runs the rounds backwards).

Defined results: null texts stay null, empty ones empty; texts without a match are not changed.
Whole texts are read.  All columns of the input are kept; ``text`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: tries to come back to a value of the same reading; each fails with a chance of about one in ten at most
WALK = 24

#: characters of an IBAN by country (the register, and codes in use without an entry)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _iban_shape(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: an IBAN of its country's length, so that no word after it is taken
_NATIONAL_IBAN = r"(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_iban_shape(n, c) for n, c in IBAN_LENGTHS.items()) + ")"
_CARD_FOURS = "[0-9]{4}(?:[ -][0-9]{4}){3}"

_MONTH_DAYS = r"(?:0?[1-9]|[12][0-9]|3[01])"
#: a bare number that looks like thousands, years or a book number is no phone; (?<=) ones ask for the text before it
_NO_PHONE = "".join([
    r"(?!(?:(?=[1-9])|(?<=[0-9][ .]))(?:[0-9]{2,3} [0-9]{3} [0-9]{3}|[0-9]{2,3}\.[0-9]{3}\.[0-9]{3})(?![0-9]))",
    r"(?!(?:19|20)[0-9]{2} [0-9]{3} [0-9]{3}(?![0-9]))(?![0-9]{2,4}[ -](?:19|20)[0-9]{2}[ -](?:19|20)[0-9]{2}(?![0-9]))",
    r"(?![1-9](?:-?[0-9]){8}-[0-9Xx](?![0-9A-Za-z-]))(?!97[89]-[0-9]{1,5}-[0-9]+-[0-9]+-[0-9](?![0-9-]))",
    r"(?!(?<=[0-9]-)[0-9]+-[0-9]+-[0-9Xx](?![0-9A-Za-z-]))(?<!97[89][ -])(?<!97[89][ -][0-9]{1,5}[ -])",
    r"(?<!(?:ISBN|isbn)(?:-1[03])?:? ?)(?<!(?:ISBN|isbn)(?:-1[03])?:? ?[0-9]{1,5}[ -])"])
#: three groups; two with a trunk zero; area code and seven or eight digits
_BARE_PHONE = (r"(?=[0-9])" + _NO_PHONE +
               r"(?:[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}|0[0-9]{1,3}[ .-][0-9]{6,8}|[0-9]{3}[ -][0-9]{7,8})(?![0-9])")

_SECRET_NAME = r"(?i:\b(?:api[_-]?key|key|token|secret|password|passwd|pwd)\b\s{0,3}[:=]\s{0,3})"
_SECRET_VALUE = "[A-Za-z0-9_+/-]{8,}+(?:[A-Za-z0-9_+/.-]*[A-Za-z0-9_+/-])?={0,2}"
#: a digit, a capital behind a small letter, padding, or hexadecimal only: words of prose have none of them
_NO_WORD = (r"(?=[A-Za-z_+/.-]*+[0-9]|[A-Za-z0-9_+/.-]*?[a-z][A-Z]|[A-Za-z0-9_+/.-]*+="
            r"|(?:[0-9a-f]{8,}+|[0-9A-F]{8,}+)(?!\.*[A-Za-z0-9_+/-]))")
#: one alternative for each kind; no groups, so that group 0 is the whole match
PATTERN = "|".join([
    r"(?<![\p{L}\p{N}_%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})\.){1,8}\p{L}{2,24}",
    rf"{_SECRET_NAME}(?:[\"']{_SECRET_VALUE}(?=[\"'])|[\"']?{_NO_WORD}{_SECRET_VALUE})",
    rf"(?i:\b(?:password|passwd|pwd)=){_SECRET_VALUE}",
    rf"\b{_NATIONAL_IBAN}\b",
    r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    rf"(?<![0-9./-])[0-9]{{4}}-(?:0[1-9]|1[0-2])-{_MONTH_DAYS}(?![0-9/-]|\.[0-9])",
    rf"(?<![0-9./-]){_MONTH_DAYS}\.(?:0?[1-9]|1[0-2])\.[0-9]{{4}}(?![0-9/-]|\.[0-9])",
    rf"(?<![0-9./-]){_MONTH_DAYS}/(?:0?[1-9]|1[0-2])/[0-9]{{4}}(?![0-9/-]|\.[0-9])",
    r"(?<![0-9./-])(?:0?[1-9]|1[0-2])/(?:1[3-9]|2[0-9]|3[01])/[0-9]{4}(?![0-9/-]|\.[0-9])",
    rf"(?<![0-9./-])[0-9]{{4}}/(?:0?[1-9]|1[0-2])/{_MONTH_DAYS}(?![0-9/-]|\.[0-9])",
    r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    rf"(?<![0-9])(?:[0-9]{{13,19}}|{_CARD_FOURS}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{2}}[ -][0-9]{{1,3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{4,5}})(?![0-9])",
    r"(?<![0-9+.])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,5}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    r"(?<![0-9+.])\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    rf"(?<![0-9+.]){_BARE_PHONE}",
    r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]){6,12}(?![0-9])",
])


def _hash(key: str, kind: str, i: Column, half: Column, mod: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), F.lit(kind), i, half), mod)


def feistel(left: Column, right: Column, left_mod: Column, right_mod: Column, key: str, kind: str,
            decrypt: bool = False) -> Column:
    """A keyed bijection of the pairs (left < left_mod, right < right_mod): a struct of l and r.

    Even rounds add a hash of the right half to the left one, odd rounds the other way round.
    """
    sign = -1 if decrypt else 1
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if decrypt else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc.l + sign * _hash(key, kind, i, acc.r, left_mod), left_mod)).otherwise(acc.l).alias("l"),
            F.when(even, acc.r).otherwise(F.pmod(acc.r + sign * _hash(key, kind, i, acc.l, right_mod), right_mod)).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(rounds, start, step)


def _power(n: Column, base: int) -> Column:
    return F.pow(F.lit(float(base)), n).cast("long")


def permute_digits(digits: Column, key: str, kind: str, decrypt: bool = False) -> Column:
    """A string of 1 to 34 digits permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, F.lit(40))
    pair = feistel(F.coalesce(left.try_cast("long"), F.lit(0)),
                   F.coalesce(right.try_cast("long"), F.lit(0)), _power(half, 10), _power(n - half, 10), key, kind, decrypt)
    joined = F.transform(F.array(pair), lambda p: F.concat(
        F.when(half > 0, F.lpad(p.l.cast("string"), half, "0")).otherwise(""), F.lpad(p.r.cast("string"), n - half, "0")))
    return joined[0]


def refill(value: Column, characters: str, new: Column) -> Column:
    """``value`` with its n-th character of the class replaced by the n-th one of ``new``."""
    filled = F.aggregate(
        F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike(f"^[{characters}]$"), F.struct(
            F.concat(acc.out, F.substring(new, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(acc.out, c).alias("out"), acc["at"].alias("at"))))
    return filled.out


def _weighted(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right; those at index % 2 == ``doubled`` count twice, digit by digit."""
    return F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")),
        lambda acc, c: F.struct((acc.s + F.when(acc.i % 2 == doubled, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10)
                                 .otherwise(c.cast("int"))).cast("int").alias("s"), (acc.i + 1).alias("i"))).s


def is_luhn(digits: Column) -> Column:
    return _weighted(digits, 1) % 10 == 0


def _luhn_digit(payload: Column) -> Column:
    return F.pmod(-_weighted(payload, 0), F.lit(10)).cast("string")


def _mod97(characters: Column) -> Column:
    """Letters count as 10 to 35."""
    return F.aggregate(F.split(characters, ""), F.lit(0), lambda acc, c: (F.when(
        c.rlike("^[0-9]$"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)).cast("int"))


def _only(value: Column, drop: str) -> Column:
    return F.regexp_replace(value, drop, "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _walk(value: Column, step, same) -> Column:
    """``step`` until ``same`` holds again: a bijection of the values for which it holds."""
    def once(v: Column) -> Column:
        return _let(step(v), lambda new: F.struct(new.alias("v"), same(new).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(value.alias("v"), F.lit(False).alias("done")),
                       lambda acc, _: F.when(acc.done, acc).otherwise(once(acc.v))).v


def _is_iban(v: Column) -> Column:
    return _let(_only(v, " "), lambda plain: F.length(plain).between(15, 34) & plain.rlike("^.{4}.*[0-9]") & (
        _mod97(F.concat(F.substring(plain, F.lit(5), F.lit(40)), F.substring(plain, 1, 4))) == 1))


def _iban_end(v: Column) -> Column:
    """Length of the longest part from the start, up to the end of a word, that is an IBAN; null if none is.

    In its country's length only the whole is tried.
    """
    ends = F.filter(F.sequence(F.length(v), F.lit(15), F.lit(-1)), lambda k: (
        (k == F.length(v)) | (F.substring(v, k + 1, F.lit(1)) == " ")) & _is_iban(F.substring(v, F.lit(1), k)))
    return F.when(F.length(v) < 15, F.lit(None).cast("int")).when(
        v.rlike(f"^{_NATIONAL_IBAN}$"), F.when(_is_iban(v), F.length(v))).otherwise(F.get(ends, F.lit(0)))


def _permuted_iban(v: Column, key: str, decrypt: bool) -> Column:
    plain = _only(v, " ")
    rest = F.substring(plain, F.lit(5), F.lit(40))
    country = F.substring(plain, 1, 2)

    def with_check(new_rest: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(new_rest, country, F.lit("00")))).cast("string"), 2, "0")
        return refill(v, "A-Z0-9", F.concat(country, check, new_rest))

    return _let(refill(rest, "0-9", permute_digits(_only(rest, "[^0-9]"), key, "iban", decrypt)), with_check)


def _iban(v: Column, key: str, decrypt: bool) -> Column:
    """The check decides where the IBAN ends; words after it stay."""
    def up_to(end: Column) -> Column:
        after = F.substring(v, end + 1, F.lit(40))
        new = _walk(F.substring(v, F.lit(1), end), lambda x: _permuted_iban(x, key, decrypt),
                    lambda x: F.coalesce(_iban_end(F.concat(x, after)) == end, F.lit(False)))
        return F.when(end.isNotNull(), F.concat(new, after)).otherwise(v)

    return _let(_iban_end(v), up_to)


def _is_card(v: Column) -> Column:
    return is_luhn(_only(v, "[^0-9]"))


def _permuted_card(v: Column, key: str, decrypt: bool) -> Column:
    digits = _only(v, "[^0-9]")
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return _let(permute_digits(payload, key, "card", decrypt), lambda p: refill(v, "0-9", F.concat(p, _luhn_digit(p))))


def _card_tail(v: Column, after: Column) -> Column:
    """The one to three digits behind four groups of four that may belong to a card of 17 to 19 digits, or be an
    expiry or a check code; digits of another value (they are not in ``after``) and of 12/25 are not tried."""
    return F.when(v.rlike(f"^{_CARD_FOURS}$"), F.regexp_extract(after, "^[ -][0-9]{1,3}(?![0-9]|[./-][0-9])", 0)).otherwise("")


def _card(v: Column, tail: Column, key: str, decrypt: bool) -> Column:
    """The longer card if it passes its check, else the shorter one and the tail as it is."""
    short = _walk(v, lambda x: _permuted_card(x, key, decrypt), lambda x: ~_is_card(F.concat(x, tail)))
    return (F.when(_is_card(F.concat(v, tail)), _permuted_card(F.concat(v, tail), key, decrypt))
            .when(_is_card(v), F.concat(short, tail)).otherwise(F.concat(v, tail)))


#: days from 1800-01-01 to 2199-12-31: one whole cycle of the calendar
_CYCLE, _LEFT_DAYS, _RIGHT_DAYS = 146097, 189, 773


def _date(v: Column, key: str, decrypt: bool) -> Column:
    year_first, month_first = v.rlike("^[0-9]{4}"), v.rlike("^[0-9]{1,2}/(?:1[3-9]|2[0-9]|3[01])/")
    mark = F.when(v.contains("/"), "/").when(v.contains("."), ".").otherwise("-")
    parts = F.split(v, "[./-]")
    day = F.try_to_date(F.when(year_first, F.concat_ws("-", parts)).when(month_first, F.concat_ws("-", parts[2], parts[0], parts[1]))
                        .otherwise(F.concat_ws("-", parts[2], parts[1], parts[0])), "yyyy-M-d")
    n = F.datediff(day, F.lit("1800-01-01").cast("date")).cast("long")

    def date_of(number: Column) -> Column:
        return F.date_add(F.lit("1800-01-01").cast("date"), number.cast("int"))

    def permuted(number: Column) -> Column:
        return _let(feistel(F.floor(number / _RIGHT_DAYS), number % _RIGHT_DAYS, F.lit(_LEFT_DAYS), F.lit(_RIGHT_DAYS), key, "date",
                            decrypt), lambda p: p.l * _RIGHT_DAYS + p.r)

    def written(new: Column) -> Column:
        y, m, d = (F.date_format(new, x) for x in ("yyyy", "MM", "dd"))
        return F.when(year_first, F.concat(y, mark, m, mark, d)).when(month_first, F.concat(m, mark, d, mark, y)).otherwise(F.concat(d, mark, m, mark, y))

    # the month is read first only where the second number cannot be one
    new = _walk(n, permuted, lambda x: ~month_first | (F.dayofmonth(date_of(x)) > 12))
    return F.when((n >= 0) & (n < _CYCLE), _let(date_of(new), written)).otherwise(v)


def _ip(v: Column, key: str, decrypt: bool) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    half = F.lit(1 << 16)
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], half, half, key, "ip", decrypt)
    new = F.transform(F.array(pair), lambda p: F.concat_ws(".", F.floor(p.l / 256), p.l % 256, F.floor(p.r / 256), p.r % 256))[0]
    return F.when(F.forall(o, lambda x: x <= 255), new).otherwise(v)


def _is_hexadecimal(word: Column) -> Column:
    return word.rlike("^(?:[0-9a-f]{8,}|[0-9A-F]{8,})$")


def _permute_word(word: Column, key: str, kind: str, decrypt: bool, tweak: Column | None = None, whole: Column | None = None) -> Column:
    """Letters and digits of a word, each permuted in its class by two alternating halves.

    A hexadecimal word stays one; else the classes of all positions stay.  The new character depends on the other half of the word.
    Other characters (non-Latin letters too) are left alone but enter the hashes, as does ``tweak``.  A part of
    ``whole`` is hexadecimal where the whole is.
    """
    whole = word if whole is None else whole
    tweaks = [] if tweak is None else [tweak]
    n = F.length(word)
    half = F.floor((n + 1) / 2).cast("int")
    sign = -1 if decrypt else 1

    hexadecimal = _is_hexadecimal(whole)

    def turned(part: Column, other: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            h = F.xxhash64(F.lit(key), F.lit(kind), i, at, other, n, *tweaks)
            code = F.ascii(c)
            value = F.conv(c, 16, 10).cast("int")
            hexed = F.lower(F.hex(F.pmod(value + sign * F.pmod(h, F.lit(16)), F.lit(16))))
            return (F.when(hexadecimal, F.when(whole == F.lower(whole), hexed).otherwise(F.upper(hexed)))
                    .when(c.rlike("^[a-z]$"), F.char(F.pmod(code - 97 + sign * F.pmod(h, F.lit(26)), F.lit(26)) + 97))
                    .when(c.rlike("^[A-Z]$"), F.char(F.pmod(code - 65 + sign * F.pmod(h, F.lit(26)), F.lit(26)) + 65))
                    .when(c.rlike("^[0-9]$"), F.char(F.pmod(code - 48 + sign * F.pmod(h, F.lit(10)), F.lit(10)) + 48))
                    .otherwise(c))
        return F.array_join(F.transform(F.split(part, ""), one), "")

    rounds = F.sequence(F.lit(3), F.lit(0)) if decrypt else F.sequence(F.lit(0), F.lit(3))
    start = F.struct(F.substring(word, F.lit(1), half).alias("l"), word.substr(half + 1, n).alias("r"))
    done = F.aggregate(rounds, start, lambda acc, i: F.struct(
        F.when(i % 2 == 0, turned(acc.l, acc.r, i)).otherwise(acc.l).alias("l"),
        F.when(i % 2 == 0, acc.r).otherwise(turned(acc.r, acc.l, i)).alias("r")))
    return F.transform(F.array(done), lambda p: F.concat(p.l, p.r))[0]


def _email(v: Column, key: str, decrypt: bool) -> Column:
    at, last = F.instr(v, "@"), F.length(v) - F.length(F.substring_index(v, ".", -1))
    local = F.substring(v, F.lit(1), at - 1)
    domain = F.substring(v, at + 1, last - at - 1)
    return F.concat(_permute_word(local, key, "email", decrypt), F.lit("@"), _permute_word(domain, key, "domain", decrypt),
                    F.substring(v, last, F.lit(40)))


#: characters of a secret that are permuted together
SECRET_PART = 64


def _secret(v: Column, key: str, decrypt: bool) -> Column:
    """The whole value in parts; the length and all parts before enter the hashes of a part."""
    name = F.regexp_extract(v, r"^([A-Za-z_-]+\s*[:=]\s*[\"']?)", 1)

    def permuted(value: Column) -> Column:
        def part(acc: Column, i: Column) -> Column:
            old = value.substr(i * SECRET_PART + 1, F.lit(SECRET_PART))
            return _let(_permute_word(old, key, "secret", decrypt, acc.tweak, value), lambda new: F.struct(
                F.concat(acc.out, F.array(new)).alias("out"), F.xxhash64(acc.tweak, new if decrypt else old).alias("tweak")))

        parts = F.sequence(F.lit(0), F.floor((F.length(value) - 1) / SECRET_PART).cast("int"))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.length(value).cast("long").alias("tweak"))
        return F.array_join(F.aggregate(parts, start, part).out, "")

    return F.concat(name, _let(v.substr(F.length(name) + 1, F.length(v)), permuted))


def _numbers(v: Column, key: str, kind: str, decrypt: bool) -> Column:
    return refill(v, "0-9", permute_digits(_only(v, "[^0-9]"), key, kind, decrypt))


def _phone(v: Column, key: str, decrypt: bool) -> Column:
    """The country code stays; a number without separators after it is permuted but for 1 digit after the plus.

    Of a bare number a trunk zero stays, and the new number passes for a phone again.
    """
    head = F.regexp_extract(v, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|0)", 1)
    bare = ~v.rlike("^[+(]")

    def permuted(x: Column) -> Column:
        return F.concat(head, _numbers(x.substr(F.length(head) + 1, F.length(x)), key, "phone", decrypt))

    return _walk(v, permuted, lambda x: ~bare | (x.rlike(f"^{_BARE_PHONE}$") & (x.startswith("0") == v.startswith("0"))))


def kind_of(v: Column) -> Column:
    digits = F.length(_only(v, "[^0-9]"))
    return (F.when(v.contains("@"), "email")
            .when(v.rlike(r"^(?i:api|key|token|secret|pass|pwd)"), "secret")
            .when(v.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
            .when(v.rlike(r"^(?:[0-9]{4}([/-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4})$"), "date")
            .when(v.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
            .when(v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(~v.startswith("+") & ~v.contains("(") & (digits >= 13), "card")
            .otherwise("phone"))


def pseudonym(v: Column, key: str, decrypt: bool = False, tail: Column | None = None) -> Column:
    """``v`` and ``tail`` (see ``_card_tail``; empty for other kinds) after the replacement."""
    tail = F.lit("") if tail is None else tail
    kind = kind_of(v)
    return (F.when(kind == "email", _email(v, key, decrypt)).when(kind == "secret", _secret(v, key, decrypt))
            .when(kind == "iban", _iban(v, key, decrypt)).when(kind == "date", _date(v, key, decrypt))
            .when(kind == "ip", _ip(v, key, decrypt)).when(kind == "ssn", _numbers(v, key, "ssn", decrypt))
            .when(kind == "card", _card(v, tail, key, decrypt)).otherwise(_phone(v, key, decrypt)))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_matches``: the matched strings in order (empty for null).

    Every kind holds a digit, an @ or the sign of an assignment; other texts are not searched.
    """
    body = F.col(f"`{text}`")
    found = F.when(body.rlike("[0-9@=:]"), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    return docs.withColumn("pii_matches", F.coalesce(found, F.array().cast("array<string>")))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", decrypt: bool = False) -> DataFrame:
    """``docs`` with every value in ``text`` replaced by its pseudonym, and ``pii_matches``.

    The text is cut at the matches and put together again with their pseudonyms.
    """
    body = F.col(f"`{text}`")

    def replaced(v: Column, after: Column) -> Column:
        """The pseudonym and the text up to the next match."""
        return _let(_card_tail(v, after), lambda tail: F.concat(
            pseudonym(v, key, decrypt, tail), after.substr(F.length(tail) + 1, F.length(after))))

    whole = _let(F.split(body, PATTERN, -1), lambda between: F.concat(between[0], F.array_join(
        F.transform("pii_matches", lambda v, i: _let(F.get(between, i + 1), lambda after: replaced(v, after))), "")))
    return find_pii(docs, text).withColumn(text, F.when(F.size("pii_matches") > 0, whole).otherwise(body))
