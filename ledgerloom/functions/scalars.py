"""Scalar functions from Column to Column; all stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def _accents() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks that decompose to an ASCII letter, and these letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower()]
    pairs = [(c, base) for c, base in pairs if base.isascii() and base != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def blank(c: Column) -> Column:
    """Text with null read as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def once(c: Column) -> Column:
    """A generator of the value as the only row, so that Catalyst doesn't compute it anew for each of its uses."""
    return F.explode(F.array(c))


def unaccented(c: Column) -> Column:
    """Lower case without accents; decomposed accents are dropped too."""
    return F.translate(F.regexp_replace(F.lower(blank(c)), "[̀-ͯ]", ""), ACCENTED, PLAIN)


def words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def normalize(c: Column) -> Column:
    return words_only(unaccented(c))


def normalize_receipt(c: Column) -> Column:
    return words_only(reduce(lambda x, rule: F.regexp_replace(x, *rule), V.RECEIPT_REWRITES, unaccented(c)))


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), c)


def tokens(c: Column) -> Column:
    """Distinct canonical words of a receipt text."""
    stop = F.array(*map(F.lit, V.STOP_WORDS))
    kept = F.filter(F.split(normalize_receipt(c), " "), lambda t: (t != "") & ~F.array_contains(stop, t))
    return F.array_distinct(F.transform(kept, lambda t: _lookup(t, V.SYNONYMS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 if either is empty."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))).otherwise(0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """Of two normalized texts; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b).cast("double") / longest).otherwise(0.0)


def _number(c: Column) -> Column:
    """A plain decimal number, else 0."""
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), c.try_cast("double")).otherwise(0.0)


def _one_comma(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\.", ""), "^([^,]*),", "$1.")


def parse_number(c: Column, mode: str = "app") -> Column:
    """Brazilian numbers in text.

    Modes: ``app`` (both marks: the last is decimal; one dot with up to 3 decimals is decimal), ``audit``
    (as app, but dots alone are read as they are), ``receipt`` (a comma is decimal; several dots go),
    ``loose`` (all but digits and marks go first).
    """
    if mode == "loose":
        s = F.regexp_replace(blank(c), r"[^0-9,.\-]", "")
        return _number(F.when(s.contains(","), _one_comma(s)).otherwise(s))
    s = F.regexp_replace(F.regexp_replace(blank(c), r"(?i)R\$", ""), r"\s", "")
    comma, dots = s.contains(","), F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    bare = F.regexp_replace(s, r"\.", "")
    if mode == "receipt":
        return _number(F.when(comma, _one_comma(s)).when(dots > 1, bare).otherwise(s))
    both = F.concat(F.regexp_replace(F.regexp_extract(s, r"^(.*)[.,]([^.,]*)$", 1), "[.,]", ""), F.lit("."), F.regexp_extract(s, r"^(.*)[.,]([^.,]*)$", 2))
    alone = s if mode == "audit" else F.when(s.rlike(r"^[^.]*\.[^.]{0,3}$") | (dots == 0), s).otherwise(bare)
    return _number(F.when(comma & (dots > 0), both).when(comma, _one_comma(s)).otherwise(alone))


def round2(c: Column, epsilon: bool = False) -> Column:
    """Two decimals, half up, as floor(x * 100 + 0.5) / 100."""
    return F.floor((c + 2.220446049250313e-16 if epsilon else c) * 100 + 0.5) / 100


def digits(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"\D", "")


def canonical_unit(c: Column) -> Column:
    return _lookup(normalize_receipt(c), V.UNIT_ALIASES)


def infer_unit(raw: Column, unit: Column, pack: Column) -> Column:
    s = normalize_receipt(raw)
    found = F.when(s.rlike(r"\bkg\b|quilo|quilograma"), "kg").when(s.rlike(r"\bml\b|mililitro"), "ml").when(s.rlike(r"\bl\b|litro"), "l").when(s.rlike(r"\bg\b|grama"), "g")
    found = found.when(blank(pack).rlike("(?i)kg"), "kg").when(blank(pack) != "", "un").otherwise("")
    return F.when(F.trim(blank(unit)) != "", canonical_unit(unit)).otherwise(found)


def parse_pack(c: Column) -> Column:
    """The first number and unit, as ``2 kg``; empty if there is none."""
    number, unit = (F.regexp_extract(blank(c), "(?i)" + V.PACK, i) for i in (1, 2))
    return F.when(number == "", "").otherwise(F.concat(F.replace(number, F.lit(","), F.lit(".")), F.lit(" "), F.lower(unit)))


def ocr_digits(c: Column) -> Column:
    return F.regexp_replace(F.translate(blank(c), "OoIl|SsBbZzGg", "0011155882266"), r"\s+", "")


def key_letters(c: Column) -> Column:
    return F.translate(F.upper(blank(c)), "OQDILZSBG", "000112586")


def money_tokens(c: Column) -> Column:
    return F.regexp_extract_all(blank(c), F.lit("(" + V.MONEY + ")"), 1)


def display_name(c: Column) -> Column:
    """A receipt's name as it is shown: short words written out, white space squeezed."""
    some = "|".join(f"(?:{p})" for p in [r"[^\S ]|\s\s", *(p for p, _ in V.DISPLAY_RULES[1:])])  # the first rule squeezes white space
    ruled = lambda s: reduce(lambda x, rule: F.regexp_replace(x, *rule), V.DISPLAY_RULES, s)
    return let(blank(c), lambda s: F.trim(F.when(s.rlike(some), ruled(s)).otherwise(s)))


def guess_pack(c: Column) -> Column:
    """The first number and unit of a name, in capitals; empty if there is none."""
    part = lambda i: F.regexp_extract(blank(c), f"(?i){V.NAME_PACK}", i)
    return let(part(1), lambda number: F.when(number == "", "").otherwise(F.concat(F.replace(number, F.lit(","), F.lit(".")), F.lit(" "), F.upper(part(2)))))


def infer_category(c: Column) -> Column:
    has = lambda n, p: reduce(Column.__or__, (n.contains(w) for w in p.split("|")))  # noqa: E731  # the patterns are words
    return let(normalize(c), lambda n: F.coalesce(*(F.when(has(n, p), name) for p, name in V.CATEGORY_PATTERNS), F.lit("Outros")))


def html_to_text(c: Column) -> Column:
    s = blank(c)
    for pattern, to in ((r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"<[^>]+>", " "), (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&quot;", '"'), (r"(?i)&#39;", "'"), (r"\s+", " ")):
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(blank(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def allowed_fiscal_url(c: Column) -> Column:
    host = url_host(c)
    return blank(c).rlike("(?i)^https://") & ~F.regexp_replace(host, r"\.$", "").rlike(V.PRIVATE_HOSTS) & host.rlike(V.FISCAL_HOSTS)


def parse_date(c: Column) -> Column:
    """dd/mm/yy or dd/mm/yyyy with / . or -; years under 50 are 20yy. Null if there is none or it's no date."""
    part = lambda i: F.regexp_extract(blank(c), r"(\d{2})[/.\-](\d{2})[/.\-](\d{2,4})", i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.when(part(3) < "50", "20").otherwise("19"), part(3))).otherwise(part(3))
    return F.concat_ws("-", year, part(2), part(1)).try_cast("date")


def parse_time(c: Column) -> Column:
    return F.regexp_extract(blank(c), r"\b((?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?)\b", 1)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once however often f uses it; unlike ``once`` it may stand in any expression."""
    return F.get(F.transform(F.array(c), f), 0)


def _places(d: Column) -> Column:
    """The digits of a text of digits as numbers."""
    return F.transform(F.split(d, ""), lambda x: F.ascii(x) - 48)


def _weight(i: int, n: int) -> int:
    """The weight modulo 11 of the i-th of n digits, from 0."""
    return 2 + (n - 1 - i) % 8


def _check_digit(a: Column, n: int, start: Column | None = None) -> Column:
    """The digit that must follow n of the digits (from ``start``)."""
    return _mod11_digit(_mod11_sum(a, n, start))


def _mod11_sum(a: Column, n: int, start: Column | None = None) -> Column:
    at = lambda i: F.get(a, F.lit(i) if start is None else start + i)
    of_weight = lambda w: reduce(Column.__add__, (at(i) for i in range(n) if _weight(i, n) == w)) * w
    return reduce(Column.__add__, map(of_weight, sorted({_weight(i, n) for i in range(n)})))


def _mod11_digit(total: Column) -> Column:
    return (11 - total % 11) % 11 % 10


def _key_at(a: Column, start: Column) -> Column:
    return _check_digit(a, 43, start) == F.get(a, start + 43)


def fiscal_key_valid(c: Column) -> Column:
    return let(digits(c), lambda d: (F.length(d) == 44) & let(_places(d), lambda a: _key_at(a, F.lit(0))))


def cnpj_valid(c: Column) -> Column:
    good = lambda a: (_check_digit(a, 12) == F.get(a, F.lit(12))) & (_check_digit(a, 13) == F.get(a, F.lit(13)))
    return let(digits(c), lambda d: (F.length(d) == 14) & ~d.rlike(r"^(\d)\1{13}$") & let(_places(d), good))


def canonical_cnpj(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")).otherwise("")


def repaired_cnpj(c: Column) -> Column:
    """The canonical number, if one digit's change makes it valid: the first by position, then digit.

    A change moves both sums by its own amount, so they are made once, not for each of the 140 changes.
    """
    weights = [F.array(*(F.lit(_weight(i, n) if i < n else 0) for i in range(14))) for n in (12, 13)]

    def changes(d: Column, a: Column, sums: Column) -> Column:
        def holds(i: Column, r: Column) -> Column:
            by = r - F.get(a, i)
            end = lambda j: F.when(i == j, r).otherwise(F.get(a, F.lit(j)))
            return (_mod11_digit(F.get(sums, F.lit(0)) + by * F.get(weights[0], i)) == end(12)) & (_mod11_digit(F.get(sums, F.lit(1)) + by * F.get(weights[1], i)) == end(13))

        text = lambda i, r: F.concat(F.substring(d, F.lit(1), i), r.cast("string"), F.substring(d, i + 2, F.lit(14)))
        each = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda r: holds(i, r)), lambda r: text(i, r))
        return F.get(F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(13)), each)), lambda x: ~x.rlike(r"^(\d)\1{13}$")), 0)

    found = lambda d: let(_places(d), lambda a: let(F.array(_mod11_sum(a, 12), _mod11_sum(a, 13)), lambda sums: changes(d, a, sums)))
    return let(digits(ocr_digits(c)), lambda d: F.when(cnpj_valid(d), canonical_cnpj(d)).when(F.length(d) == 14, F.coalesce(canonical_cnpj(found(d)), F.lit(""))).otherwise(""))


def gtin_valid(c: Column) -> Column:
    def good(a: Column) -> Column:
        total = reduce(Column.__add__, (F.get(a, F.lit(i)) * (1 if i % 2 else 3) for i in range(13)))
        return (10 - total % 10) % 10 == F.get(a, F.lit(13))

    return let(digits(c), lambda d: (F.length(d) == 4) | (F.length(d).isin(8, 12, 13, 14) & let(_places(F.lpad(d, 14, "0")), good)))


def _first_key(digits_: Column) -> Column:
    """The first 44 of the digits that are a valid key, or null."""
    at = lambda d: let(_places(d), lambda a: F.get(F.filter(F.sequence(F.lit(0), F.length(d) - 44), lambda p: _key_at(a, p)), 0))
    return let(digits_, lambda d: F.when(F.length(d) >= 44, F.substring(d, at(d) + 1, F.lit(44))))


def key_from_text(c: Column) -> Column:
    """The first valid 44-digit key, line by line, then over the whole text; empty if there is none."""
    by_line = lambda lines: F.get(F.array_compact(F.transform(lines, lambda x: _first_key(digits(x)))), 0)
    whole = lambda lines: F.when(F.size(lines) > 1, _first_key(digits(F.array_join(lines, ""))))
    return let(F.split(key_letters(c), r"\r?\n"), lambda lines: F.coalesce(by_line(lines), whole(lines), F.lit("")))


def key_from_qr(c: Column) -> Column:
    """The key in the address's p parameter, else in the first 44 digits; empty if not valid."""
    first = lambda url: digits(F.regexp_extract(F.coalesce(F.try_url_decode(url), url), r"(?i)(?:^|[?&])p=([^&#|]*)", 1))
    other = lambda url: F.regexp_extract(F.regexp_replace(url, r"\s", ""), r"(\d{44})", 1)
    valid = lambda k, otherwise: let(k, lambda d: F.when(fiscal_key_valid(d), d).otherwise(otherwise))
    return let(F.trim(blank(c)), lambda url: valid(first(url), valid(other(url), F.lit(""))))


def market_key(c: Column) -> Column:
    """A market's name without the words of its type."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize(c), V.MARKET_TYPES, " "), r"\s+", " "))


def market_similarity(a: Column, b: Column) -> Column:
    """Of two market keys: 1 if equal, else shared words over the larger count; 0 if either is empty."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    share = F.size(F.array_intersect(x, y)).cast("double") / F.greatest(F.size(x), F.size(y))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(share)
