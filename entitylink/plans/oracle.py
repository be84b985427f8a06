"""DuckDB SQL for the registered queries that SQL can express, written apart from the operators."""

from __future__ import annotations

import unicodedata

from ..functions import tables as T

_FOLD = "trim(regexp_replace(replace(translate(lower(coalesce({0}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


def fold(x: str) -> str:
    return _FOLD.format(x)


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _suffix(code: str) -> str:
    one = "(?:" + "|".join(sorted(T.LEGAL_SUFFIXES[code], key=lambda s: (-len(s.split()), -len(s)))) + ")"
    return rf"(?:^|\s+){one}(?:\s+{one})*$"


def strip_legal(x: str, country: str) -> str:
    cases = " ".join(f"WHEN {country} = '{c}' THEN regexp_replace({x}, '{_suffix(c)}', '')" for c in ("us", "in", "fr"))
    return f"trim(CASE {cases} ELSE regexp_replace({x}, '{_suffix('default')}', '') END)"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def street(x: str) -> str:
    return f"list_transform({tokens(x)}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN coalesce(nullif(ltrim(t, '0'), ''), '0') ELSE coalesce({_map(T.STREET_TERMS)}[t], t) END)"


def grams(x: str, n: int) -> str:
    return cut(f"replace({x}, ' ', '')", n)


def cut(v: str, n: int) -> str:
    """N-grams of a text without spaces."""
    return f"CASE WHEN length({v}) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(1, length({v}) - {n - 1}) + 1), lambda i: {v}[i : i + {n - 1}]))) END"


#: Records with what their makers put into them: domain, alias, house numbers and postal code are known, not extracted.
R = r"""
r0 AS (
  SELECT 'S' || (coalesce(TRY_CAST(replace(source, 'src', '') AS INTEGER), 0) % 3 + 1) AS source, doc_id,
    trim(regexp_extract(coalesce(text, ''), '^[^.!?\n]*', 0)) AS base_name,
    replace(trim(regexp_replace(regexp_extract(coalesce(text, ''), '^[^.!?\n]*[.!?\n]+([^.!?\n]*)', 1), '[0-9]+', '', 'g')), 'ß', 'ss') AS base_street, coalesce(lang, '') AS country
  FROM documents),
r1 AS (SELECT *, CAST(length(base_street) % 89 + 1 AS VARCHAR) AS h, CAST(10000 + length(base_street) * 37 % 900 AS VARCHAR) AS code, doc_id % 7 = 0 AS web, doc_id % 7 = 1 AS trades, doc_id % 7 <> 0 AND doc_id % 3 <> 2 AS numbered FROM r0),
rec AS (
  SELECT *, source || '-' || doc_id AS entity_id,
    CASE WHEN web THEN 'www.shop' || doc_id || '.com' WHEN trades THEN base_name || ' d/b/a shop' || (doc_id - 1) ELSE base_name END AS business_name,
    CASE WHEN web THEN '' WHEN numbered THEN base_street || ' ' || h || CASE doc_id % 4 WHEN 0 THEN '/7' WHEN 1 THEN '-9' ELSE '' END || ' ' || code ELSE base_street END AS business_address,
    CASE WHEN web THEN ['shop' || doc_id || '.com'] ELSE [] END AS domains, CASE WHEN web THEN ['shop' || doc_id] ELSE [] END AS domain_names,
    CASE WHEN NOT numbered THEN [] WHEN doc_id % 4 = 0 THEN list_distinct([h || '/7', h, '7']) WHEN doc_id % 4 = 1 THEN list_distinct([h, '9']) ELSE [h] END AS houses,
    CASE WHEN numbered THEN [code] ELSE [] END AS postals
  FROM r1)
"""
N = f"""{R},
n0 AS (SELECT *, {fold('country')} AS country_code0, {fold('business_name')} AS name_clean, {fold('business_address')} AS street0, {fold('base_name')} AS base_clean FROM rec),
n1 AS (SELECT *, coalesce({_map(T.COUNTRY_ALIASES)}[country_code0], country_code0) AS country_code, CASE WHEN web THEN '' ELSE name_clean END AS bare FROM n0),
n2 AS (SELECT *, {strip_legal('bare', 'country_code')} AS core, {strip_legal('base_clean', 'country_code')} AS base_core, {street('street0')} AS street_tokens FROM n1),
n AS MATERIALIZED (SELECT *, array_to_string(street_tokens, ' ') AS street, replace(core, ' ', '') AS core_packed, replace(array_to_string(street_tokens, ' '), ' ', '') AS street_packed, {tokens('core')} AS name_tokens, replace(core, ' ', '')[1:4] AS n4,
        replace(array_to_string(street_tokens, ' '), ' ', '')[1:3] AS s3, coalesce(nullif(country_code, ''), '__unknown__') AS c,
        CASE WHEN trades THEN list_filter(CASE WHEN base_core <> base_clean THEN [base_clean, base_core, 'shop' || (doc_id - 1)] ELSE [base_clean, 'shop' || (doc_id - 1)] END, lambda x: x <> '') ELSE [] END AS aliases FROM n2)
"""


def _unmarked(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))


#: What case folding and NFKD without marks make of each character that they change; Hangul is reckoned.
_UNICODE = {c: _unmarked(c) for c in map(chr, range(0x41, 0x110000)) if not ("\ud800" <= c <= "\udfff" or "가" <= c <= "힣") and _unmarked(c) != c}
_HANGUL = "chr(4352 + (unicode(c) - 44032) // 588) || chr(4449 + (unicode(c) - 44032) % 588 // 28) || CASE WHEN (unicode(c) - 44032) % 28 > 0 THEN chr(4519 + (unicode(c) - 44032) % 28) ELSE '' END"
#: Latin letters for each character of the scripts that are transliterated.
_LETTERS = {chr(k): T.BRAHMIC.get((k - 0x900) % 0x80, "") for k in range(0x900, 0xD80)} | {chr(k): (x if chr(k).islower() else x.capitalize()) for k in range(0x400, 0x500) for x in [T.CYRILLIC.get(chr(k).lower(), "")]}


def _chars(x: str, each: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {each}), '')"


def fold_unicode(x: str) -> str:
    """Letters and numbers of all scripts; texts of ASCII and accented Latin letters as ``fold`` has them."""
    each = f"CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN {_HANGUL} ELSE coalesce({_map({c: f.replace(chr(39), chr(39) * 2) for c, f in _UNICODE.items()})}[c], c) END"
    return rf"CASE WHEN regexp_matches({x}, '[^\x00-\x7FàáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝß]') THEN trim(regexp_replace({_chars(x, each)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) ELSE {fold(x)} END"


def _unicode_names() -> str:
    """``N`` with every text folded as Unicode and, of names in Brahmic or Cyrillic letters, what their Latin ones make."""
    n = N
    for x in ("country", "business_name", "business_address", "base_name"):
        n = n.replace(fold(x), fold_unicode(x))
    script = r"regexp_matches(business_name, '[\x{0900}-\x{0D7F}\x{0400}-\x{04FF}]')"
    latin = fold_unicode(_chars("business_name", f"coalesce({_map(_LETTERS)}[c], c)"))
    return n + f""",
l0 AS (SELECT *, CASE WHEN {script} THEN {latin} ELSE '' END AS latin0 FROM n),
l1 AS (SELECT *, CASE WHEN latin0 = name_clean THEN '' ELSE {strip_legal('latin0', 'country_code')} END AS latin1 FROM l0),
l AS MATERIALIZED (SELECT *, CASE WHEN latin1 <> '' THEN latin1 ELSE core END AS latin, CASE WHEN latin1 <> '' THEN {tokens('latin1')} ELSE name_tokens END AS latin_tokens FROM l1)
"""


def _key(strategy: str, key: str) -> str:
    return f"{{'s': '{strategy}', 'k': {key}}}"


def _one(strategy: str, key: str, when: str) -> str:
    return f"(CASE WHEN {when} THEN [{_key(strategy, key)}] ELSE [] END)"


def _each(strategy: str, values: str, key: str, var: str = "x") -> str:
    return f"list_transform({values}, lambda {var}: {_key(strategy, key)})"


def _cat(*lists: str) -> str:
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


def _keys(rules: str = "full", n: str = "n", latin: str = "core", words: str = "name_tokens") -> str:
    """(source, entity_id, raw country, major, minor, strategy, key) of the records ``n``; ``minor`` orders keys within a part."""
    pairs = "flatten(list_transform(houses, lambda h: list_transform(postals, lambda p: h || '|' || p)))"
    first = _cat(
        _one("name_exact_country", "c || '|' || core", "core <> ''"), _one("name_prefix_country", "c || '|' || n4", "core <> ''"), _each("name_char4_country", cut("core_packed", 4), "c || '|' || x"),
        _one("address_exact_country", "c || '|' || street", "street <> ''"), _one("street_prefix_country", "c || '|' || s3", "street <> ''"), _each("address_char4_country", cut("street_packed", 4), "c || '|' || x"),
        _one("name_address_exact_country", "c || '|' || core || '|' || street", "core <> '' AND street <> ''"), _each("house_postal_country", pairs, "c || '|' || x"), _each("domain_country", "domains", "c || '|' || x"),
    )
    last = "[]"
    if rules == "full":
        start = "replace(a, ' ', '')[1:4]"
        of_alias = _cat(f"[{_key('alias_exact_country', chr(39).join(['c || ', '|', ' || a']))}]", f"(CASE WHEN length({start}) >= 4 THEN [{_key('alias_prefix_country', f'c || {chr(39)}|{chr(39)} || {start}')}, {_key('name_prefix_country', f'c || {chr(39)}|{chr(39)} || {start}')}] ELSE [] END)", _each("alias_token_country", "list_filter(string_split(a, ' '), lambda t: length(t) >= 4)", "c || '|' || y", "y"))
        alias = f"flatten(list_transform(list_concat(aliases, domain_names), lambda a: {of_alias}))"
        word = "list_filter(street_tokens, lambda t: length(t) >= 5 AND NOT regexp_full_match(t, '[0-9]+'))"
        last = _cat(
            _one("translit_exact_country", f"c || '|' || {latin}", f"{latin} <> ''"), _one("translit_prefix_country", f"c || '|' || replace({latin}, ' ', '')[1:3]", f"length(replace({latin}, ' ', '')) >= 3"), _each("translit_token_country", f"list_distinct(list_filter({words}, lambda t: length(t) >= 4))", "c || '|' || x"),
            _one("name_exact_countryless", "'__any__|' || core", "core <> '' AND country_code IN ('', 'unknown', '__unknown__')"), _each("house_postal_countryless", pairs, "'__any__|' || x"), _one("name_street_prefix_spec", "c || '|' || n4 || '|' || s3", "n4 <> '' AND s3 <> ''"),
            _one("name_prefix_postal_spec", "c || '|' || n4 || '|' || postals[1][1:3]", "n4 <> '' AND len(postals) > 0"), _one("name_prefix_addr_tok_spec", f"c || '|' || n4 || '|' || ({word})[1]", f"n4 <> '' AND len({word}) > 0"),
        )
    else:
        alias = _each("alias_country", "aliases", "c || '|' || x")
    part = lambda k, lst: f"SELECT source, entity_id, country, {k} AS major, i AS minor, x.s AS strategy, x.k AS key FROM (SELECT source, entity_id, country, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM (SELECT *, {lst} AS g FROM {n}))"
    return f"{part(1, first)} UNION ALL SELECT source, entity_id, country, major, min(minor) AS minor, strategy, key FROM ({part(2, alias)}) GROUP BY ALL" + (f" UNION ALL {part(3, last)}" if rules == "full" else "")


def _engine(cap: int, rules: str = "full", unicode: bool = False) -> str:
    over = ""
    if rules == "full":
        over = """
  UNION ALL
  SELECT o.entity_id, p.source, p.entity_id, o.strategy || '_smart_overflow', o.major, o.minor, s.major * 1000 + s.minor, 0
  FROM k o JOIN b bo ON o.strategy = bo.strategy AND o.key = bo.key AND bo.capped
  JOIN k s ON s.entity_id = o.entity_id AND s.strategy IN ('name_street_prefix_spec', 'name_prefix_postal_spec', 'name_prefix_addr_tok_spec')
  JOIN b bs ON s.strategy = bs.strategy AND s.key = bs.key AND NOT bs.capped
  JOIN p ON p.strategy = s.strategy AND p.key = s.key
  WHERE o.source = 'S1' AND o.strategy IN ('name_prefix_country', 'street_prefix_country', 'name_char4_country', 'address_char4_country')"""
    names, keys = (_unicode_names(), _keys(rules, "l", "latin", "latin_tokens")) if unicode else (N, _keys(rules))
    return f"""{names},
k AS MATERIALIZED ({keys}),
p AS MATERIALIZED (SELECT DISTINCT strategy, key, source, entity_id FROM k WHERE source <> 'S1'),
b AS MATERIALIZED (SELECT strategy, key, count(*) AS bucket_size, count(*) > {cap} AS capped FROM p GROUP BY ALL),
hit AS (
  SELECT k.entity_id AS source1_id, p.source AS target_source, p.entity_id AS target_id, k.strategy, k.major, k.minor, 0 AS spec, 1 AS hit
  FROM k JOIN b ON k.strategy = b.strategy AND k.key = b.key AND NOT b.capped JOIN p ON p.strategy = k.strategy AND p.key = k.key
  WHERE k.source = 'S1'{over}),
cand AS MATERIALIZED (SELECT source1_id, target_source, target_id, arg_min(strategy, (major, minor, spec)) AS strategy, CAST(sum(hit) AS BIGINT) AS hits FROM hit GROUP BY ALL)
"""


def _older() -> str:
    """(strategy, key) of the older channels."""
    c = "country_code || '_"
    both = "flatten(list_transform(houses, lambda h: list_transform(postals, lambda p: {'s': 'hn_postal', 'k': " + f"{c}hnpc_' || h || '_' || p" + "})))"
    rare = lambda words: "t NOT IN (" + ", ".join(f"'{w}'" for w in words) + ")"
    name = "replace(CASE WHEN core <> '' THEN core ELSE name_clean END, ' ', '')"
    plain = "replace(replace(replace(replace(x, '.com', ''), '.org', ''), '.net', ''), '.', '_')"
    lists = _cat(
        _one("exact_name", f"{c}en_' || name_clean", "name_clean <> ''"), _one("exact_name", f"{c}en_' || core", "core <> '' AND core <> name_clean"), _one("exact_addr", f"{c}ea_' || street", "street <> ''"), _one("exact_name_addr", f"{c}ena_' || name_clean || '_' || street", "name_clean <> '' AND street <> ''"),
        _one("name_prefix", f"{c}np_' || {name}[1:6]", f"length({name}) >= 4"), _one("street_prefix", f"{c}sp_' || street_packed[1:8]", "length(street_packed) >= 4"), _each("name_4grams", cut("core_packed", 4), f"{c}n4g_' || x"), _each("addr_4grams", cut("street_packed", 4), f"{c}a4g_' || x"),
        both, _each("domain", "domains", f"{c}dom_' || {plain}"), _each("dba_alias", "aliases", f"{c}alias_' || x"),
        _each("address_core", "list_filter(houses, lambda z: length(z) >= 3 OR contains(z, '/'))", f"{c}hn_' || x"), f"(CASE WHEN street <> '' THEN {_each('address_core', 'houses', f'{c}h_{chr(39)} || x || {chr(39)}_{chr(39)} || street[1:4]')} ELSE [] END)",
        _each("postal_name", "postals", f"{c}p_' || x"), f"(CASE WHEN core <> '' THEN {_each('postal_name', 'postals', f'{c}p_{chr(39)} || x || {chr(39)}_{chr(39)} || core[1:3]')} ELSE [] END)",
        _each("name_token", f"list_filter(name_tokens[1:3], lambda t: length(t) >= 3 AND {rare(T.NAME_STOP_WORDS)})", f"{c}n_' || x"), _each("address_token", f"list_filter(street_tokens, lambda t: length(t) >= 5 AND NOT regexp_full_match(t, '[0-9]+') AND {rare(T.ADDRESS_STOP_WORDS)})", f"{c}at_' || x"),
        _each("domain_alias", "domains", f"{c}dom_' || {plain}"), f"flatten(list_transform(aliases, lambda a: list_transform(list_filter(string_split(a, ' '), lambda t: length(t) >= 3 AND {rare(T.NAME_STOP_WORDS)})[1:2], lambda y: {_key('domain_alias', f'{c}alias_{chr(39)} || y')})))",
    )
    return f"SELECT x.s AS strategy, x.k AS key FROM (SELECT unnest({lists}) AS x FROM n)"


TRUTH = r"""w0 AS (SELECT source, entity_id, doc_id, trim(regexp_replace(regexp_replace(lower(business_address), '[0-9/\-]+', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM rec),
o AS (SELECT words, min(entity_id) AS source1_id FROM w0 WHERE source = 'S1' AND len(string_split(words, ' ')) >= 3 GROUP BY words),
gt AS MATERIALIZED (
  SELECT o.source1_id, w0.source AS target_source, w0.entity_id AS target_id FROM w0 JOIN o USING (words) WHERE w0.source <> 'S1'
  UNION SELECT a.entity_id, b.source, b.entity_id FROM w0 a JOIN w0 b ON b.doc_id = a.doc_id + 1 WHERE a.source = 'S1' AND b.source <> 'S1' AND (a.doc_id % 7 = 0 OR a.doc_id % 50 = 0))
"""
LISTS = f"""{R}, {TRUTH},
l AS (SELECT n.entity_id AS source1_id, list_filter(list(gt.target_id), lambda x: x IS NOT NULL) AS target_ids FROM rec n LEFT JOIN gt ON gt.source1_id = n.entity_id WHERE n.source = 'S1' GROUP BY ALL)
"""


def _jac(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {u} = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / {u} END"


def _con(a: str, b: str) -> str:
    m = f"least(len(list_distinct({a})), len(list_distinct({b})))"
    return f"CASE WHEN {m} = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / {m} END"


def _edit(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE greatest(0.0, 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) END"


def _i(x: str) -> str:
    return f"CAST(({x}) AS BIGINT)"


def _shares(x: str) -> str:
    return f"len(list_intersect(a.{x}, b.{x})) > 0"


def _features(cap: int) -> str:
    known = lambda x: f"{x}.country_code NOT IN ('', 'unknown')"
    ex = "a.core = b.core AND a.core <> ''"
    ax = "a.street = b.street AND a.street <> ''"
    full = "a.core <> '' AND b.core <> ''"
    afull = "a.street <> '' AND b.street <> ''"
    has = lambda x: f"len(a.{x}) > 0 AND len(b.{x}) > 0"
    ints = {
        "country_match": f"a.country_code = b.country_code AND {known('a')}", "country_conflict": f"a.country_code <> b.country_code AND {known('a')} AND {known('b')}", "country_missing_either": f"NOT ({known('a')} AND {known('b')})",
        "name_exact": ex, "address_exact": ax, "name_address_exact": f"{ex} AND {ax}", "house_exact": _shares("houses"), "postal_exact": _shares("postals"), "domain_exact": _shares("domains"), "alias_exact": _shares("aliases"),
        "name_nonempty_both": full, "address_nonempty_both": afull, "domain_available_both": has("domains"), "alias_available_both": has("aliases"), "name_address_both_available": f"{full} AND {afull}",
        "houses_lacking": f"NOT ({has('houses')})", "postals_lacking": f"NOT ({has('postals')})",
    }
    nums = {
        "name_edit_similarity": _edit("a.core", "b.core"), "name_token_jaccard": _jac("a.name_tokens", "b.name_tokens"), "name_token_containment": _con("a.name_tokens", "b.name_tokens"), "name_sorted_token_jaccard": _jac("a.name_tokens", "b.name_tokens"),
        "name_char3_jaccard": _jac("a.g3", "b.g3"), "name_char4_jaccard": _jac("a.g4", "b.g4"), "name_length_ratio": _ratio("a.core", "b.core"), "address_edit_similarity": _edit("a.street", "b.street"),
        "address_token_jaccard": _jac("a.street_tokens", "b.street_tokens"), "address_token_containment": _con("a.street_tokens", "b.street_tokens"), "address_char3_jaccard": _jac("a.h3", "b.h3"), "address_char4_jaccard": _jac("a.h4", "b.h4"),
        "address_length_ratio": _ratio("a.street", "b.street"), "house_overlap": _con("a.houses", "b.houses"), "postal_overlap": _con("a.postals", "b.postals"), "domain_jaccard": _jac("a.domains", "b.domains"), "alias_jaccard": _jac("a.aliases", "b.aliases"),
    }
    cols = ", ".join([f"{_i(v)} AS {k}" for k, v in ints.items()] + [f"CAST({v} AS DOUBLE) AS {k}" for k, v in nums.items()])
    return f"""{_engine(cap)}, {TRUTH},
g AS MATERIALIZED (SELECT *, {cut('core_packed', 3)} AS g3, {cut('core_packed', 4)} AS g4, {cut('street_packed', 3)} AS h3, {cut('street_packed', 4)} AS h4 FROM n),
f0 AS (SELECT x.source1_id, x.target_source, x.target_id, {cols} FROM cand x JOIN g a ON a.entity_id = x.source1_id JOIN g b ON b.entity_id = x.target_id),
f AS MATERIALIZED (SELECT f0.*, 1::BIGINT AS blocking_hit_count, 1::BIGINT AS blocking_strategy_count,
  name_exact + address_exact + house_exact * postal_exact + domain_exact + alias_exact AS strong_evidence_count,
  name_exact + address_exact + CAST(name_token_jaccard >= 0.8 AS BIGINT) + CAST(address_token_jaccard >= 0.8 AS BIGINT) + house_exact + postal_exact + domain_exact + alias_exact + country_match AS combined_evidence_count,
  CAST(name_nonempty_both = 0 AS BIGINT) + CAST(address_nonempty_both = 0 AS BIGINT) + houses_lacking + postals_lacking AS missing_field_count,
  CASE WHEN gt.target_id IS NULL THEN 0 ELSE 1 END::BIGINT AS label,
  floor((round(name_edit_similarity, 8) + round(address_token_jaccard, 8)) / 2 * 1e6 + 0.5e0) / 1e6 AS score
  FROM f0 LEFT JOIN gt ON gt.source1_id = f0.source1_id AND gt.target_id = f0.target_id)
"""


def _s1(cap: int, where: str = "score >= 0.6") -> str:
    return f"""{_features(cap)},
pr AS (SELECT source1_id, target_id, label FROM f WHERE {where}),
m0 AS (SELECT n.entity_id AS source1_id, (SELECT count(*) FROM pr WHERE pr.source1_id = n.entity_id) AS n_pred, (SELECT count(*) FROM gt WHERE gt.source1_id = n.entity_id) AS n_true, (SELECT count(*) FROM pr WHERE pr.source1_id = n.entity_id AND label = 1) AS tp FROM n WHERE n.source = 'S1'),
m1 AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp::DOUBLE / n_pred END::DOUBLE AS precision, CASE WHEN n_true = 0 THEN 1.0 ELSE tp::DOUBLE / n_true END::DOUBLE AS recall FROM m0),
m AS MATERIALIZED (SELECT *, CASE WHEN n_true = 0 AND n_pred > 0 THEN 0.0 WHEN precision + recall = 0 THEN 0.0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END::DOUBLE AS f FROM m1)
"""


def _clusters(cap: int) -> str:
    """Components over accepted pairs by repeated minima over walks."""
    return f"""{_features(cap)},
e AS MATERIALIZED (SELECT 'S1:' || source1_id AS a, target_source || ':' || target_id AS b FROM f WHERE score >= 0.55 AND country_conflict = 0),
w AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
walk(x, y) AS (SELECT u, u FROM w UNION SELECT walk.x, w.v FROM walk JOIN w ON w.u = walk.y),
node AS MATERIALIZED (SELECT x AS node, min(y) AS component, string_split(x, ':')[1] AS source, x[length(string_split(x, ':')[1]) + 2 :] AS entity_id FROM walk GROUP BY x),
size AS (SELECT component, count(*) AS node_count, CAST(sum(CAST(source = 'S1' AS BIGINT)) AS BIGINT) AS s1_count, CAST(sum(CAST(source <> 'S1' AS BIGINT)) AS BIGINT) AS target_count FROM node GROUP BY component)
"""


_R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_R86 = lambda *cs: ", ".join(f"floor(round({c}, 8) * 1e6 + 0.5e0) / 1e6 AS {c}" for c in cs)


def _profile() -> str:
    out = ["count(*) AS rows", "count(DISTINCT entity_id) AS distinct_ids"]
    for c in ("entity_id", "business_name", "business_address", "country"):
        out += [f"CAST(sum(CAST({c} IS NULL AS BIGINT)) AS BIGINT) AS {c}_null", f"CAST(sum(CAST(trim(coalesce({c}, '')) = '' AS BIGINT)) AS BIGINT) AS {c}_missing"]
    for c in ("business_name", "business_address"):
        for name, v in (("length", f"length({c})"), ("tokens", rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda t: t <> ''))")):
            out += [f"round(CAST({agg}({v}) AS DOUBLE), 4) AS {c}_{name}_{f}" for f, agg in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))]
    return f"WITH RECURSIVE {R} SELECT {', '.join(out)} FROM rec"


def _policies() -> str:
    free = "country_conflict = 0"
    p = {"p0": "score >= 0.875", "p1_a": "(score >= 0.875 OR (strong_evidence_count >= 1 AND score >= 0.70))", "p1_b": "(score >= 0.875 OR (strong_evidence_count >= 1 AND score >= 0.60))", "p2": "(score >= 0.875 OR (score >= 0.65 AND address_token_jaccard > 0))"}
    return ", ".join(f"CAST(sum(CAST({free} AND {v} AND label = {y} AS BIGINT)) AS BIGINT) AS {k}_{w}" for k, v in p.items() for y, w in ((1, "tp"), (0, "fp")))


def _rescue() -> str:
    rows = []
    for r in (0.50, 0.60, 0.70, 0.75, 0.80, 0.825, 0.85, 0.875):
        n = lambda c: f"CAST(coalesce(sum(CAST({c} AS BIGINT)), 0) AS BIGINT)"
        hit = f"strong_evidence_count >= 1 AND score >= {r}"
        tp, fp = n(f"{hit} AND score < 0.875 AND label = 1"), n(f"{hit} AND score < 0.875 AND label = 0")
        rows.append(f"SELECT {r}::DOUBLE AS rescue_threshold, {tp} AS additional_tp_recovered, {fp} AS introduced_fp, round(coalesce({tp} / nullif({tp} + {fp}, 0)::DOUBLE, 1.0), 4) AS rescue_precision, {n(f'{hit} AND label = 0')} = 0 AS safe FROM f")
    return " UNION ALL ".join(rows)


def _band(x: str) -> str:
    ends = ((0.90, "<0.90"), (0.95, "0.90-0.95"), (0.99, "0.95-0.99"), (0.995, "0.99-0.995"), (0.999, "0.995-0.999"))
    return "CASE " + " ".join(f"WHEN {x} < {e}::DOUBLE THEN '{n}'" for e, n in ends) + " ELSE '0.999-1.0' END"


def _words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'))"


def _miss_kinds() -> str:
    x, y = _words("a.business_name"), _words("b.business_name")
    starts = lambda w: f"list_transform(list_filter({w}, lambda t: length(t) >= 4), lambda t: t[1:4])"
    within = lambda v, w: f"len(list_filter({v}, lambda t: NOT list_contains({w}, t))) = 0"
    name = f"CASE WHEN len(x) = 0 OR len(y) = 0 THEN 'NAME_EMPTY' WHEN {within('x', 'y')} AND {within('y', 'x')} THEN 'NAME_TOKEN_EXACT' WHEN {within('x', 'y')} OR {within('y', 'x')} THEN 'NAME_TOKEN_CONTAINMENT' WHEN len(list_intersect(x, y)) > 0 THEN 'NAME_PARTIAL_OVERLAP' WHEN len(list_intersect({starts('x')}, {starts('y')})) > 0 THEN 'NAME_PREFIX_SIMILAR' ELSE 'NAME_NO_TOKEN_OVERLAP' END"
    country = "CASE WHEN trim(ca) = '' OR trim(cb) = '' THEN 'COUNTRY_MISSING' WHEN lower(trim(ca)) = lower(trim(cb)) THEN 'COUNTRY_MATCH' ELSE 'COUNTRY_CONFLICT' END"
    return f"SELECT {name} AS name_kind, {country} AS country_kind, count(*) AS n FROM (SELECT {x} AS x, {y} AS y, a.country AS ca, b.country AS cb FROM missed JOIN rec a ON a.entity_id = missed.source1_id JOIN rec b ON b.entity_id = missed.target_id) GROUP BY 1, 2"


LABELS = "s AS (SELECT doc_id, quality AS label, (doc_id * 37 % 101) / 100.0::DOUBLE AS score FROM labels)"
#: The production settings.
_CAP, _FAST = 500, 50


def build() -> dict[str, str]:
    w = "WITH RECURSIVE "
    n, eng, feat = w + N, w + _engine(_CAP), w + _features(_CAP)
    pair = "source1_id, target_source, target_id"
    names = ["country_match", "country_conflict", "country_missing_either", "name_exact", "address_exact", "name_address_exact", "house_exact", "postal_exact", "domain_exact", "alias_exact", "name_nonempty_both", "address_nonempty_both", "domain_available_both", "alias_available_both", "name_address_both_available", "blocking_hit_count", "blocking_strategy_count", "combined_evidence_count", "strong_evidence_count", "missing_field_count"]
    reals = ["name_edit_similarity", "name_token_jaccard", "name_token_containment", "name_sorted_token_jaccard", "name_char3_jaccard", "name_char4_jaccard", "name_length_ratio", "address_edit_similarity", "address_token_jaccard", "address_token_containment", "address_char3_jaccard", "address_char4_jaccard", "address_length_ratio", "house_overlap", "postal_overlap", "domain_jaccard", "alias_jaccard"]
    ranked = "row_number() OVER (PARTITION BY source1_id ORDER BY score DESC, score DESC, target_source DESC, target_id DESC)"
    gap = "max(score) OVER (PARTITION BY source1_id) - coalesce(nth_value(score, 2) OVER (PARTITION BY source1_id ORDER BY score DESC, target_source DESC, target_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0)"
    decided = "CASE WHEN score < {t} THEN 'below_threshold' WHEN country_conflict = 1 THEN 'country_conflict_veto' {strong} ELSE 'threshold_pass' END"
    size = f"b AS MATERIALIZED (SELECT strategy, key, count(*) AS bucket_size, count(*) > {_CAP} AS capped FROM (SELECT DISTINCT strategy, key, source, entity_id FROM k WHERE source <> 'S1') GROUP BY ALL)"
    keyed = f"{n}, k AS MATERIALIZED ({_keys()})"
    qs = (0.5, 0.9, 0.95, 0.99)
    sorted_ = "z AS (SELECT list_sort(list(bucket_size)) AS v, count(*) AS n FROM b)"
    nearest = lambda q: f"CAST(round_even({q} * (n - 1), 0) AS BIGINT)"
    kinds = [f"SELECT 'linear' AS kind, {q}::DOUBLE AS q, round(CAST((SELECT quantile_cont(bucket_size, {q}) FROM b) AS DOUBLE), 6) AS value" for q in qs]
    kinds += [f"SELECT '{k}', {q}::DOUBLE, CAST(v[1 + {at}] AS DOUBLE) FROM z" for q in qs for k, at in (("nearest", nearest(q)), ("floor", f"least(CAST(floor({q}::DOUBLE * n) AS BIGINT), n - 1)"), ("ceil", f"greatest(0, CAST(ceil({q}::DOUBLE * n) AS BIGINT) - 1)"))]
    misses_from = f"{eng}, {TRUTH}, " + _engine(_CAP, "plain").replace(N, "").strip().lstrip(",").replace("k AS MATERIALIZED", "k0 AS MATERIALIZED").replace("FROM k WHERE", "FROM k0 WHERE").replace("FROM k JOIN b", "FROM k0 k JOIN b0 b").replace("p AS MATERIALIZED", "p0 AS MATERIALIZED").replace("b AS MATERIALIZED", "b0 AS MATERIALIZED").replace("FROM p GROUP", "FROM p0 GROUP").replace("JOIN p ON", "JOIN p0 p ON").replace("hit AS (", "hit0 AS (").replace("cand AS", "cand0 AS").replace("FROM hit GROUP", "FROM hit0 GROUP")
    missed = "FROM gt WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.source1_id = gt.source1_id AND c.target_id = gt.target_id) AND NOT EXISTS (SELECT 1 FROM cand0 c WHERE c.source1_id = gt.source1_id AND c.target_id = gt.target_id)"
    fast_spec = "strategy IN ('name_street_prefix_spec', 'name_prefix_postal_spec', 'name_prefix_addr_tok_spec')"
    loop = "strategy NOT LIKE '%char4%' AND strategy NOT LIKE '%street_prefix%'"
    cl = w + _clusters(_CAP)
    grid = "SELECT i / 400.0::DOUBLE AS t FROM range(401) g(i)"
    swept = f"{feat}, g0 AS ({grid}), x AS (SELECT g0.t, n.entity_id AS i, (SELECT count(*) FROM gt WHERE gt.source1_id = n.entity_id) AS nt, coalesce(q.np, 0) AS np, coalesce(q.tp, 0) AS tp FROM g0 CROSS JOIN (SELECT entity_id FROM n WHERE source = 'S1') n LEFT JOIN (SELECT g0.t, source1_id, count(*) AS np, CAST(sum(label) AS BIGINT) AS tp FROM f JOIN g0 ON f.score >= g0.t GROUP BY ALL) q ON q.t = g0.t AND q.source1_id = n.entity_id), y AS (SELECT *, CASE WHEN nt = 0 AND np = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE tp / np::DOUBLE END::DOUBLE AS p, CASE WHEN nt = 0 THEN 1.0 ELSE tp / nt::DOUBLE END::DOUBLE AS r FROM x), v AS (SELECT *, CASE WHEN nt = 0 AND np > 0 THEN 0.0 WHEN p + r = 0 THEN 0.0 ELSE 1.25 * p * r / (0.25 * p + r) END::DOUBLE AS f FROM y), swept AS (SELECT round(t, 6) AS threshold, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f05, CAST(sum(tp) AS BIGINT) AS pair_tp, CAST(sum(np - tp) AS BIGINT) AS pair_fp, CAST(sum(nt - tp) AS BIGINT) AS pair_fn, count(*) FILTER (nt = 0 AND np > 0) AS singleton_false_positives FROM v GROUP BY t)"
    policy = f"x AS (SELECT *, {ranked} AS rk, count(*) OVER (PARTITION BY source1_id) AS cn, {gap} AS gap, max(CAST(score >= 0.7 AND country_conflict = 0 AS INTEGER)) OVER (PARTITION BY source1_id) AS hit FROM f), y AS (SELECT *, CASE WHEN hit = 1 THEN 'global_threshold' WHEN country_conflict = 1 THEN 'rescue_country_conflict' WHEN score < 0.45 THEN 'rescue_score_below_floor' WHEN cn > 1 AND gap < 0.05 THEN 'rescue_margin_too_small' WHEN combined_evidence_count < 1 THEN 'rescue_insufficient_evidence' ELSE 's1_argmax_rescue' END AS reason FROM x WHERE CASE WHEN hit = 1 THEN score >= 0.7 AND country_conflict = 0 ELSE rk = 1 END), z AS (SELECT source1_id, target_source, target_id, score, gap, reason, CASE WHEN reason IN ('global_threshold', 's1_argmax_rescue') THEN 'MATCH' ELSE 'NO_MATCH' END AS decision FROM y UNION ALL SELECT entity_id, NULL, NULL, NULL, NULL, 'no_candidates', 'NO_MATCH' FROM n WHERE source = 'S1' AND entity_id NOT IN (SELECT source1_id FROM f))"
    odd = f"{fold('business_name')} || ' ' || (['co ltd', 'sarl fils', 'pvt ltd inc', 'llc x'])[1 + length(business_name) % 4]"
    return {
        "canonical_country": f"WITH x AS (SELECT n_name AS country FROM nation UNION ALL SELECT * FROM (SELECT DISTINCT coalesce(lang, '') FROM documents)) SELECT country, coalesce({_map(T.COUNTRY_ALIASES)}[{fold('country')}], {fold('country')}) AS country_code FROM x",
        "fold_text": f"SELECT doc_id, md5({fold('text')}) AS folded_md5, length({fold('text')}) AS n FROM documents",
        "legal_suffix_strip": f"{w}{R} SELECT entity_id, {strip_legal(odd, 'country')} AS core FROM rec",
        "street_tokens": f"{w}{R} SELECT entity_id, array_to_string({street(fold('business_address') + chr(124) * 2 + repr(' street 007 road ') + chr(124) * 2 + ' length(business_address)')}, ' ') AS street FROM rec",
        "char_ngrams": f"{w}{R}, y AS MATERIALIZED (SELECT entity_id, replace({fold('business_name')}, ' ', '') AS v FROM rec) SELECT entity_id, array_to_string({cut('v', 3)}, ',') AS grams3, array_to_string({cut('v', 4)}, ',') AS grams4 FROM y",
        "domain_extract": r"WITH d AS (SELECT page_id, lower(regexp_extract(url, '^(?:https?://)?(?:www\.)?([^/:?#]+)', 1)) AS h, lower(regexp_extract(url, '^[^:]*://[^/]*/(?:.*/)?([a-z0-9][a-z0-9-]*\.[a-z]{2,})$', 1)) AS f FROM pages) SELECT page_id, h || CASE WHEN f = '' THEN '' ELSE ',' || f END AS domains, string_split(h, '.')[-2] AS base FROM d",
        "postal_codes": "SELECT s_suppkey, CAST(s_suppkey * 37 % 90000 + 10000 AS VARCHAR) AS postal FROM supplier",
        "alias_parts": "SELECT c_custkey, c_name || '|Shop ' || c_custkey AS parts FROM customer",
        "identity_keys": f"SELECT c_custkey, 'domain:shop' || c_custkey || ' com;alias:' || {fold('c_name')} AS keys FROM customer",
        "lenient_casts": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_custkey::DOUBLE ELSE -1.0 END AS as_double, CASE WHEN c_custkey % 3 = 2 THEN c_custkey ELSE -1 END::BIGINT AS as_int, c_custkey % 3 = 1 OR c_custkey = 1 AS as_bool FROM customer",
        "normalize_unicode": f"{n} SELECT entity_id, name_clean, core AS name_core, street, CAST(len({cut('core_packed', 4)}) AS INTEGER) AS n_char4 FROM n",
        "profile_source": _profile(),
        "profile_countries": f"{w}{R} SELECT trim(country) AS country, count(*) AS n FROM rec WHERE trim(country) <> '' GROUP BY 1",
        "index_report": f"{keyed}, q AS (SELECT DISTINCT strategy, key, source, entity_id FROM k WHERE source <> 'S1'), t AS (SELECT strategy, count(*) AS n FROM q GROUP BY 1) SELECT count(DISTINCT strategy || '=' || key) AS keys, count(*) AS entries, count(DISTINCT entity_id) AS entities, (SELECT strategy FROM t ORDER BY n DESC, strategy DESC LIMIT 1) AS largest_strategy FROM q",
        "net_new_pairs": f"{misses_from}, m AS (SELECT strategy, count(*) AS n FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand0 x WHERE x.source1_id = c.source1_id AND x.target_id = c.target_id) GROUP BY 1) SELECT strategy, CASE WHEN strategy LIKE '%alias%' THEN 'alias_channel' WHEN strategy LIKE '%translit%' THEN 'transliteration_channel' WHEN strategy LIKE '%countryless%' THEN 'country_fallback_channel' WHEN strategy LIKE '%exact%' OR strategy LIKE '%prefix%' OR strategy LIKE '%char4%' THEN 'smart_capping_subkeys' ELSE 'other' END AS channel, n FROM m",
        "truth_inverse": f"{w}{R}, {TRUTH} SELECT target_id, arg_max(source1_id, CAST(split_part(source1_id, '-', 2) AS BIGINT)) AS source1_id FROM gt GROUP BY 1",
        "profile_top_tokens": r"WITH t AS (SELECT unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')) AS token FROM documents) SELECT token, count(*) AS n FROM t WHERE length(token) > 2 GROUP BY token ORDER BY n DESC, token LIMIT 15",
        "truth_profile": f"{w}{LISTS}, t AS (SELECT t, count(DISTINCT source1_id) AS k FROM (SELECT source1_id, unnest(target_ids) AS t FROM l) GROUP BY t) SELECT count(*) AS s1, count(*) FILTER (len(target_ids) = 0) AS zero_match, count(*) FILTER (len(target_ids) = 1) AS one_match, count(*) FILTER (len(target_ids) > 0) AS matched, CAST(sum(len(target_ids)) AS BIGINT) AS links, CAST(max(len(target_ids)) AS INTEGER) AS most_matches, (SELECT count(*) FROM t) AS targets, (SELECT count(*) FROM t WHERE k > 1) AS shared_targets, (SELECT coalesce(max(k), 0) FROM t) AS most_s1 FROM l",
        "match_histogram": f"{w}{LISTS} SELECT CAST(len(target_ids) AS INTEGER) AS matches, count(*) AS s1 FROM l GROUP BY 1",
        "block_keys": f"{keyed} SELECT strategy, count(*) AS n, count(DISTINCT key) AS n_keys FROM k GROUP BY strategy",
        "bucket_stats": f"{keyed}, {size} SELECT * FROM b WHERE bucket_size > 1",
        "bucket_percentiles": f"{keyed}, {size}, {sorted_} {' UNION ALL '.join(kinds)}",
        "bucket_report": f"{keyed}, {size} SELECT count(*) AS keys, count(*) FILTER (capped) AS capped_keys, CAST(coalesce(sum(bucket_size) FILTER (capped), 0) AS BIGINT) AS capped_rows, max(bucket_size) AS largest, round(avg(bucket_size), 6) AS mean_size FROM b",
        "largest_buckets": f"{keyed}, {size} SELECT * FROM b ORDER BY bucket_size DESC, strategy, key LIMIT 20",
        "candidates_engine": f"{eng} SELECT * FROM cand",
        "candidates_plain": f"{w}{_engine(_CAP, 'plain')} SELECT {pair} FROM cand",
        "candidates_fast": f"{keyed}, k1 AS (SELECT * FROM k WHERE {loop}), ent AS (SELECT * FROM k1 WHERE source <> 'S1' UNION ALL SELECT * FROM k WHERE source <> 'S1' AND {fast_spec}), u AS (SELECT country, key, count(*) AS n FROM ent GROUP BY ALL), pr AS (SELECT country, key, entity_id FROM k1 WHERE source = 'S1'), sp AS (SELECT country, key, entity_id FROM k WHERE source = 'S1' AND {fast_spec}), probe AS (SELECT * FROM pr UNION SELECT sp.* FROM sp WHERE EXISTS (SELECT 1 FROM pr JOIN u ON u.country = pr.country AND u.key = pr.key AND u.n > {_FAST} WHERE pr.entity_id = sp.entity_id)) SELECT DISTINCT probe.entity_id AS source1_id, ent.source AS target_source, ent.entity_id AS target_id FROM probe JOIN u ON u.country = probe.country AND u.key = probe.key AND u.n <= {_FAST} JOIN ent ON ent.country = probe.country AND ent.key = probe.key",
        "channel_counts": f"{w}{_engine(_CAP, unicode=True)} SELECT CASE WHEN strategy LIKE '%alias%' THEN 'alias_channel' WHEN strategy LIKE '%translit%' THEN 'transliteration_channel' WHEN strategy LIKE '%countryless%' THEN 'country_fallback_channel' WHEN strategy LIKE '%exact%' OR strategy LIKE '%prefix%' OR strategy LIKE '%char4%' THEN 'smart_capping_subkeys' ELSE 'other' END AS channel, count(*) AS n FROM cand GROUP BY 1",
        "candidate_counts": f"{eng} SELECT n.entity_id AS source1_id, (SELECT count(*) FROM cand WHERE cand.source1_id = n.entity_id) AS n FROM n WHERE source = 'S1'",
        "truncated_index": f"{keyed}, q AS (SELECT DISTINCT key, entity_id AS target_id, CAST(split_part(entity_id, '-', 2) AS BIGINT) AS seq FROM k WHERE source <> 'S1') SELECT key, target_id, seq FROM q QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq, target_id) <= {_CAP}",
        "older_keys": f"{n} SELECT strategy, count(*) AS n, count(DISTINCT key) AS n_keys FROM ({_older()}) GROUP BY strategy",
        "probe_by_key": f"{keyed}, p AS (SELECT DISTINCT strategy, key, entity_id FROM k WHERE source <> 'S1'), u AS (SELECT key FROM p GROUP BY key HAVING count(*) <= {_CAP}), o AS (SELECT DISTINCT entity_id, key FROM k WHERE source = 'S1') SELECT o.entity_id AS source1_id, p.entity_id AS target_id, count(*) AS hits, array_to_string(list_sort(list(DISTINCT strategy)), ',') AS strategies FROM o JOIN u USING (key) JOIN p USING (key) GROUP BY 1, 2",
        "blocking_recall": f"{eng}, {TRUTH}, x AS (SELECT n.entity_id AS i, (SELECT count(*) FROM gt WHERE gt.source1_id = n.entity_id) AS t, (SELECT count(*) FROM cand c WHERE c.source1_id = n.entity_id) AS c, (SELECT count(*) FROM gt JOIN cand c ON c.source1_id = gt.source1_id AND c.target_id = gt.target_id WHERE gt.source1_id = n.entity_id) AS h FROM n WHERE source = 'S1'), y AS (SELECT CAST(sum(t) AS BIGINT) AS true_pairs, CAST(sum(h) AS BIGINT) AS covered, CAST(sum(t) - sum(h) AS BIGINT) AS missed, CAST(sum(c) AS BIGINT) AS candidates, count(*) AS s1, count(*) FILTER (t = 0) AS zero_match_s1, count(*) FILTER (t > 0 AND t = h) AS fully_covered_s1 FROM x) SELECT *, round(coalesce(covered / nullif(true_pairs, 0), 0)::DOUBLE, 6) AS recall, round(covered / candidates::DOUBLE, 6) AS positive_rate, round(candidates / s1::DOUBLE, 6) AS mean_candidates, round(1 - candidates / (s1 * (SELECT count(*) FROM n WHERE source <> 'S1'))::DOUBLE, 6) AS reduction FROM y",
        "strategy_recall": f"{eng}, {TRUTH} SELECT strategy, count(*) AS covered, round(100 * count(*) / (SELECT count(*) FROM gt)::DOUBLE, 2) AS recall_percent FROM cand JOIN gt USING (source1_id, target_id) GROUP BY strategy",
        "blocking_misses": f"{misses_from}, missed AS (SELECT gt.* {missed}) SELECT m.source1_id, m.target_id, m.target_source, a.business_name AS source1_name, b.business_name AS target_name, a.business_address AS source1_address, b.business_address AS target_address, a.country AS source1_country, b.country AS target_country, false AS baseline_present, false AS enhanced_present, 'NO_B0_NO_B5' AS failure_reason FROM missed m JOIN n a ON a.entity_id = m.source1_id JOIN n b ON b.entity_id = m.target_id",
        "miss_kinds": f"{misses_from}, missed AS (SELECT gt.* {missed}) {_miss_kinds()}",
        "ablation_delta": f"{misses_from} SELECT gt.source1_id, gt.target_id FROM gt JOIN cand c ON c.source1_id = gt.source1_id AND c.target_id = gt.target_id WHERE NOT EXISTS (SELECT 1 FROM cand0 c WHERE c.source1_id = gt.source1_id AND c.target_id = gt.target_id)",
        "pair_features": f"{feat} SELECT {pair}, {', '.join(names)}, {_R86(*reals)}, label FROM f",
        "row_decisions": f"{feat}, d AS (SELECT *, {decided.format(t=0.6, strong=chr(87) + 'HEN strong_evidence_count < 1 THEN ' + repr('missing_strong_evidence_veto'))} AS decision_reason FROM f) SELECT CASE WHEN decision_reason = 'threshold_pass' THEN 'MATCH' ELSE 'NON_MATCH' END AS decision, decision_reason, count(*) AS n, CAST(sum(label) AS BIGINT) AS true_pairs FROM d GROUP BY 1, 2",
        "s1_margins": f"{feat} SELECT {pair}, {ranked} AS rank, count(*) OVER (PARTITION BY source1_id) AS candidates, round({gap}, 6) AS margin FROM f",
        "s1_policy": f"{feat}, {policy} SELECT source1_id, CASE WHEN decision = 'MATCH' THEN target_source END AS target_source, CASE WHEN decision = 'MATCH' THEN target_id END AS target_id, decision, reason, score AS calibrated_score, round(gap, 6) AS margin, reason = 's1_argmax_rescue' AS rescue_used FROM z",
        "s1_policy_plain": f"{feat}, x AS (SELECT source1_id, score >= 0.8625::DOUBLE AND country_conflict = 0 AS ok FROM f), y AS (SELECT n.entity_id AS i, count(x.ok) AS c, count(*) FILTER (x.ok) AS hits FROM n LEFT JOIN x ON x.source1_id = n.entity_id WHERE n.source = 'S1' GROUP BY 1), z AS (SELECT CASE WHEN hits > 0 THEN 'MATCH' ELSE 'NO_MATCH' END AS decision, CASE WHEN hits > 0 THEN 'global_threshold' WHEN c > 0 THEN 'below_global_threshold' ELSE 'no_candidates' END AS reason, greatest(hits, 1) AS k FROM y) SELECT decision, reason, CAST(sum(k) AS BIGINT) AS n FROM z GROUP BY ALL",
        "simple_policies": f"{feat} SELECT {_policies()} FROM f",
        "competitive_policy": f"{feat}, x AS (SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY score DESC, target_source, target_id) AS rk, {gap} AS gap FROM f) SELECT {pair}, score FROM x WHERE country_conflict = 0 AND (score >= 0.7 OR (rk = 1 AND score >= 0.4 AND strong_evidence_count >= 1 AND gap >= 0.10))",
        "s1_metrics": f"{w}{_s1(_CAP)} SELECT source1_id, tp, n_pred, n_true, {_R6('precision', 'recall', 'f')} FROM m",
        "cohort_metrics": f"{w}{_s1(_CAP)}, z AS (SELECT count(*) AS s1, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f) AS macro_f05, count(*) FILTER (n_true = 0) AS singletons, count(*) FILTER (n_true = 0 AND n_pred > 0) AS singleton_false_positives, CAST(sum(tp) AS BIGINT) AS pair_tp, CAST(sum(n_pred - tp) AS BIGINT) AS pair_fp, CAST(sum(n_true - tp) AS BIGINT) AS pair_fn FROM m) SELECT s1, {_R6('macro_precision', 'macro_recall', 'macro_f05')}, singletons, singleton_false_positives, pair_tp, pair_fp, pair_fn, round(coalesce(pair_tp / nullif(pair_tp + pair_fp, 0)::DOUBLE, 1.0), 6) AS pair_precision, round(coalesce(pair_tp / nullif(pair_tp + pair_fn, 0)::DOUBLE, 0.0), 6) AS pair_recall FROM z",
        "ablation_metrics": f"{w}{_s1(_CAP)}, z AS (SELECT avg(precision) AS p, avg(recall) AS r FROM m) SELECT round(p, 6) AS macro_precision, round(r, 6) AS macro_recall, round(1.25 * p * r / (0.25 * p + r), 6) AS macro_f05 FROM z",
        "threshold_sweep": f"{swept} SELECT * FROM swept",
        "ranking_measures": f"WITH {LABELS}, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY score), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp FROM g), t AS (SELECT sum(label) AS pp, sum(1 - label) AS nn, avg((score - label) * (score - label)) AS brier FROM s) SELECT round(CAST(sum(p * (cp / cn::DOUBLE)) / max(pp) AS DOUBLE), 6) AS average_precision, round(CAST(sum((n - p) * (cp - p / 2.0)) / max(pp * nn) AS DOUBLE), 6) AS roc_auc, round(max(brier), 6) AS brier FROM c, t",
        "confusion_at": f"WITH {LABELS}, c AS (SELECT count(*) FILTER (score >= 0.4 AND label = 1) AS tp, count(*) FILTER (score >= 0.4 AND label = 0) AS fp, count(*) FILTER (score < 0.4 AND label = 1) AS fn, count(*) FILTER (score < 0.4 AND label = 0) AS tn FROM s) SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM c",
        "score_bands": f"WITH {LABELS}, t AS (SELECT 0.9::DOUBLE + score / 10 AS score, label FROM s) SELECT {_band('score')} AS band, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM t GROUP BY 1",
        "rescue_simulation": f"{feat} {_rescue()}",
        "strong_scores": f"{feat} SELECT label, count(*) AS \"count\", round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.95), 6) AS p95, round(max(score), 6) AS max FROM f WHERE strong_evidence_count >= 1 GROUP BY label",
        "evaluated_s1": f"{w}{R}, {TRUTH} SELECT DISTINCT source1_id FROM gt",
        "threshold_choice": f"{swept}, ok AS (SELECT *, macro_precision >= 0.5 AS good FROM swept) SELECT threshold, macro_precision, macro_f05 FROM ok ORDER BY good DESC, macro_f05 DESC, macro_precision DESC, threshold LIMIT 1",
        "connected_components": w + _features(_CAP) + ", w AS (SELECT source1_id AS u, target_id AS v FROM f WHERE score >= 0.55 UNION SELECT target_id, source1_id FROM f WHERE score >= 0.55), walk(x, y) AS (SELECT u, u FROM w UNION SELECT walk.x, w.v FROM walk JOIN w ON w.u = walk.y) SELECT x AS node, min(y) AS component FROM walk GROUP BY x",
        "edge_reasons": f"{feat} SELECT CASE WHEN score < 0.55 OR country_conflict = 1 THEN 'not_match' WHEN score < 0.6 THEN 'below_minimum' ELSE 'accepted' END AS edge_reason, count(*) AS n FROM f GROUP BY 1",
        "cluster_sizes": f"{cl} SELECT node_count, s1_count, target_count, CAST(node_count > 3 AS INTEGER) AS oversized, count(*) AS clusters FROM size GROUP BY ALL",
        "cluster_report": f"{cl} SELECT count(*) AS clusters, CAST(sum(node_count) AS BIGINT) AS nodes, max(node_count) AS largest, round(avg(node_count), 6) AS mean_size, round(CAST(quantile_cont(node_count, 0.5) AS DOUBLE), 6) AS p50, round(CAST(quantile_cont(node_count, 0.9) AS DOUBLE), 6) AS p90, round(CAST(quantile_cont(node_count, 0.99) AS DOUBLE), 6) AS p99, count(*) FILTER (s1_count > 1) AS multi_s1, count(*) FILTER (target_count > 1) AS multi_target, count(*) FILTER (node_count > 3) AS oversized FROM size",
        "s1_resolution": f"{cl} SELECT a.entity_id AS source1_id, coalesce((SELECT array_to_string(list_sort(list(entity_id)), ',') FROM node b WHERE b.component = a.component AND b.source = 'S2'), '') AS s2_ids, coalesce((SELECT array_to_string(list_sort(list(entity_id)), ',') FROM node b WHERE b.component = a.component AND b.source = 'S3'), '') AS s3_ids, size.node_count AS cluster_size, s1_count, target_count FROM node a JOIN size USING (component) WHERE a.source = 'S1'",
        "closure_pairs": f"{cl} SELECT a.entity_id AS source1_id, b.source AS target_source, b.entity_id AS target_id FROM node a JOIN node b USING (component) WHERE a.source = 'S1' AND b.source <> 'S1'",
        "closure_metrics": f"{cl}, x AS (SELECT a.entity_id AS source1_id, b.entity_id AS target_id FROM node a JOIN node b USING (component) WHERE a.source = 'S1' AND b.source <> 'S1'), y AS (SELECT (SELECT count(*) FROM x JOIN gt USING (source1_id, target_id)) AS tp, (SELECT count(*) FROM x) AS np, (SELECT count(*) FROM gt) AS nt), z AS (SELECT tp, np - tp AS fp, nt - tp AS fn, coalesce(tp / nullif(np, 0)::DOUBLE, 0.0) AS precision, coalesce(tp / nullif(nt, 0)::DOUBLE, 0.0) AS recall FROM y) SELECT tp, fp, fn, {_R6('precision', 'recall')}, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1 FROM z",
        "population": f"{feat} SELECT s.singleton, s.has_features, count(*) AS n FROM (SELECT NOT EXISTS (SELECT 1 FROM gt WHERE gt.source1_id = n.entity_id) AS singleton, EXISTS (SELECT 1 FROM f WHERE f.source1_id = n.entity_id) AS has_features FROM n WHERE source = 'S1') s GROUP BY ALL",
        "leakage_audit": f"{eng}, pt AS (SELECT entity_id AS source1_id, CASE WHEN doc_id % 7 = 0 THEN 'holdout' ELSE 'train' END AS role FROM n WHERE source = 'S1') SELECT 's1_overlap' AS \"check\", 0::BIGINT AS violations, true AS fatal UNION ALL SELECT 'missing_population', (SELECT count(DISTINCT source1_id) FROM cand WHERE source1_id NOT IN (SELECT source1_id FROM pt)), true UNION ALL SELECT 'threshold_on_holdout', 0, true UNION ALL SELECT 'shared_targets', (SELECT count(*) FROM (SELECT target_id FROM cand JOIN pt USING (source1_id) GROUP BY target_id HAVING count(DISTINCT role) > 1)), false",
        "submission_format": f"{eng} SELECT n.entity_id AS source1_entity_id, coalesce((SELECT array_to_string(list_sort(list(DISTINCT target_id)), ',') FROM cand WHERE cand.source1_id = n.entity_id), '') AS candidate_entity_ids, n.doc_id AS row_seq FROM n WHERE source = 'S1'",
        "candidate_reader": f"{eng} SELECT DISTINCT source1_id, target_id FROM cand",
        "truth_reader": f"{w}{R}, {TRUTH} SELECT source1_id, target_id, target_source FROM gt",
    }


SQL = build()
