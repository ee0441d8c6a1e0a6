"""DuckDB SQL for the scalar functions, written apart from them so that one checks the other."""

from __future__ import annotations

from ..functions import vocabulary as V


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, '{flags}')"


def plain(x: str) -> str:
    return f"lower(strip_accents(coalesce({x}, '')))"


def words(x: str) -> str:
    return f"trim({sub(x, '[^a-z0-9]+', ' ')})"


def norm(x: str) -> str:
    return words(plain(x))


def norm_receipt(x: str) -> str:
    s = plain(x)
    for pattern, to in V.RECEIPT_REWRITES:
        s = sub(s, pattern, to.replace("$", "\\"))
    return words(s)


def lookup(x: str, table: dict[str, str]) -> str:
    return "case " + x + " " + " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items()) + f" else {x} end"


def tokens(x: str) -> str:
    stop = "[" + ", ".join(map(q, V.STOP_WORDS)) + "]"
    return f"list_distinct([{lookup('t', V.SYNONYMS)} for t in string_split({norm_receipt(x)}, ' ') if t <> '' and not list_contains({stop}, t)])"


def jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end"


def edit(a: str, b: str) -> str:
    return f"case when {a} = '' or {b} = '' then 0.0::double else 1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) end"


def number(x: str) -> str:
    return f"case when regexp_matches({x}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') then cast({x} as double) else 0.0::double end"


def one_comma(x: str) -> str:
    return f"regexp_replace(replace({x}, '.', ''), '^([^,]*),', '\\1.')"


def parse_number(x: str, mode: str) -> str:
    if mode == "loose":
        s = sub(f"coalesce({x}, '')", "[^0-9,.-]", "")
        return number(f"(case when contains({s}, ',') then {one_comma(s)} else {s} end)")
    s = sub(sub(f"coalesce({x}, '')", "R\\$", "", "gi"), "\\s", "")
    comma, dots, bare = f"contains({s}, ',')", f"(length({s}) - length(replace({s}, '.', '')))", f"replace({s}, '.', '')"
    if mode == "receipt":
        return number(f"(case when {comma} then {one_comma(s)} when {dots} > 1 then {bare} else {s} end)")
    both = f"regexp_replace(regexp_extract({s}, '^(.*)[.,]([^.,]*)$', 1), '[.,]', '', 'g') || '.' || regexp_extract({s}, '^(.*)[.,]([^.,]*)$', 2)"
    alone = s if mode == "audit" else f"(case when {dots} = 0 or ({dots} = 1 and length(string_split({s}, '.')[2]) <= 3) then {s} else {bare} end)"
    return number(f"(case when {comma} and {dots} > 0 then {both} when {comma} then {one_comma(s)} else {alone} end)")


def digits(x: str) -> str:
    return sub(f"coalesce({x}, '')", "[^0-9]", "")


def unit(x: str) -> str:
    return lookup(norm_receipt(x), V.UNIT_ALIASES)


def pack(x: str) -> str:
    n = f"regexp_extract(coalesce({x}, ''), {q(V.PACK)}, 1, 'i')"
    return f"case when {n} = '' then '' else replace({n}, ',', '.') || ' ' || lower(regexp_extract(coalesce({x}, ''), {q(V.PACK)}, 2, 'i')) end"


def category(x: str) -> str:
    return "case " + " ".join(f"when regexp_matches({norm(x)}, {q(p)}) then {q(c)}" for p, c in V.CATEGORY_PATTERNS) + " else 'Outros' end"


def html_text(x: str) -> str:
    s = f"coalesce({x}, '')"
    for pattern, to, flags in (("<script.*?</script>", " ", "gis"), ("<style.*?</style>", " ", "gis"), ("<[^>]+>", " ", "g"), ("&nbsp;", " ", "gi"), ("&amp;", "&", "gi"), ("&quot;", '"', "gi"), ("&#39;", "'", "gi"), ("\\s+", " ", "g")):
        s = sub(s, pattern, to, flags)
    return f"trim({s})"


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\\[[^\\]]*\\]|[^/:?#]*)', 1))"


def allowed_url(x: str) -> str:
    return f"starts_with(lower({x}), 'https://') and not regexp_matches(regexp_replace({host(x)}, '\\.$', ''), {q(V.PRIVATE_HOSTS)}) and regexp_matches({host(x)}, {q(V.FISCAL_HOSTS)})"


def date(x: str) -> str:
    part = lambda i: f"regexp_extract(coalesce({x}, ''), '(\\d{{2}})[/.-](\\d{{2}})[/.-](\\d{{2,4}})', {i})"
    year = f"case when length({part(3)}) = 2 then (case when {part(3)} < '50' then '20' else '19' end) || {part(3)} else {part(3)} end"
    return f"try_cast(({year}) || '-' || {part(2)} || '-' || {part(1)} as date)"


def weighted(d: str, n: int) -> str:
    return f"list_sum([cast(substr({d}, p, 1) as integer) * (2 + ({n} - p) % 8) for p in range(1, {n + 1})])"


def key_valid(d: str) -> str:
    return f"case when length({d}) <> 44 then false else (case when 11 - {weighted(d, 43)} % 11 >= 10 then 0 else 11 - {weighted(d, 43)} % 11 end) = cast(substr({d}, 44, 1) as integer) end"


def cnpj_valid(d: str) -> str:
    dv = lambda n: f"(case when {weighted(d, n)} % 11 < 2 then 0 else 11 - {weighted(d, n)} % 11 end)"
    return f"case when length({d}) <> 14 or {d} = repeat(substr({d}, 1, 1), 14) then false else {dv(12)} = cast(substr({d}, 13, 1) as integer) and {dv(13)} = cast(substr({d}, 14, 1) as integer) end"


def cnpj(d: str) -> str:
    return f"case when length({d}) = 14 then substr({d}, 1, 2) || '.' || substr({d}, 3, 3) || '.' || substr({d}, 6, 3) || '/' || substr({d}, 9, 4) || '-' || substr({d}, 13, 2) else '' end"


def gtin_valid(d: str) -> str:
    total = f"list_sum([cast(substr({d}, p, 1) as integer) * (case when (length({d}) - 1 - p) % 2 = 0 then 3 else 1 end) for p in range(1, length({d}))])"
    return f"case when length({d}) = 4 then true when length({d}) not in (8, 12, 13, 14) then false else (10 - {total} % 10) % 10 = cast(substr({d}, length({d}), 1) as integer) end"


def market_key(x: str) -> str:
    return f"trim({sub(sub(norm(x), V.MARKET_TYPES, ' '), ' +', ' ')})"


def market_similarity(a: str, b: str) -> str:
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"case when {a} = '' or {b} = '' then 0.0::double when {a} = {b} then 1.0::double else len(list_intersect({x}, {y}))::double / greatest(len({x}), len({y})) end"


def score4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def display(x: str) -> str:
    s = f"coalesce({x}, '')"
    for pattern, to in V.DISPLAY_RULES:
        s = sub(s, pattern.replace("(?i)", ""), to.replace("$", "\\"), "gi")
    return f"trim({s})"


def guess_pack(x: str) -> str:
    part = lambda i: f"regexp_extract({x}, {q(V.NAME_PACK)}, {i}, 'i')"
    return f"case when {part(1)} = '' then '' else replace({part(1)}, ',', '.') || ' ' || upper({part(2)}) end"
