"""The registered queries in DuckDB SQL, put together from common table expressions."""

from __future__ import annotations

from kinfold.config import SINGLE_CAPS, LinkageConfig
from kinfold.functions.similarity import ALPHABET
from kinfold.functions.text import ADDRESS_WORDS, LEGAL_WORDS, STOP_WORDS
from kinfold.operators.model import THRESHOLDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

ENT = """ent AS (SELECT 'S' || (doc_id % 3 + 1) AS src, doc_id AS row_idx, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id,
  left(split_part(text, chr(10), 1), 60) || list_extract(['', ' Inc.', ' Pvt Ltd', ' & Co', ' Group'], (doc_id % 5 + 1)::INT) AS business_name,
  (n_chars % 1000) || ' ' || right(text, 40) AS business_address, lang AS country FROM documents)"""


def norm(x: str) -> str:
    folded = f"regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(replace(lower({folded}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def legal(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '\\b({'|'.join(LEGAL_WORDS)})\\b', ' ', 'g'), ' +', ' ', 'g'))"


def toks(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END"


DIGIT = "regexp_full_match(t, '[0-9]+')"
KEYED = f"""n0 AS (SELECT *, {norm('business_name')} AS text_name, {norm('business_address')} AS norm_addr FROM ent),
n1 AS (SELECT *, {legal('text_name')} AS norm_name FROM n0),
n2 AS (SELECT *, {toks('norm_name')} AS nt, {toks('norm_addr')} AS ad FROM n1),
n3 AS (SELECT *, list_filter(nt, lambda t: NOT list_contains({STOP}, t)) AS sig, list_filter(ad, lambda t: {DIGIT}) AS nums,
  list_filter(ad, lambda t: NOT {DIGIT} AND length(t) > 2 AND NOT list_contains({STOP}, t)) AS words,
  list_filter(ad, lambda t: {DIGIT} AND length(t) >= 3) AS zips FROM n2),
keyed AS (SELECT *, array_to_string(list_sort(CASE WHEN len(sig) > 0 THEN sig ELSE nt END), ' ') AS sorted_name,
  array_to_string(list_sort(sig[1:2]), ' ') AS first2_name,
  CASE WHEN len(nums) > 0 AND len(words) > 0 THEN nums[1] || '_' || words[1] WHEN len(words) >= 2 THEN words[1] || '_' || words[2] ELSE '' END AS addr_num_street,
  array_to_string(zips[1:2], '_') AS zip_number, list_filter(sig, lambda t: length(t) >= 4) AS core FROM n3)"""

DF = """tok AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(core)) AS token FROM keyed WHERE src <> 'S1') GROUP BY token)"""
RAREST = """cpos AS (SELECT src, row_idx, entity_id, country, unnest(core) AS token, unnest(range(len(core))) AS pos FROM keyed),
rarest AS (SELECT src, row_idx, entity_id, country, arg_min(token, {'f': coalesce(df, 0), 'p': pos}) AS token, min(coalesce(df, 0)) AS df
  FROM cpos LEFT JOIN tok USING (token) GROUP BY ALL)"""


def keys(ceiling: int = 5000) -> str:
    own = (("exact_name", "norm_name"), ("sorted_name", "sorted_name"), ("first2_tokens", "first2_name"), ("address_key", "addr_num_street"))
    parts = [f"SELECT src, row_idx, entity_id, coalesce(country, '') AS country, '{c}' AS channel, {k} AS key FROM keyed WHERE {k} <> ''" for c, k in own]
    parts.append(f"SELECT src, row_idx, entity_id, coalesce(country, ''), 'rare_token', token FROM rarest WHERE df <= {ceiling}")
    return f"{KEYED}, {DF}, {RAREST}, keys AS ({' UNION ALL '.join(parts)})"


def caps(values: dict[str, int]) -> str:
    case = " ".join(f"WHEN '{c}' THEN {n}" for c, n in values.items())
    return f"""capped AS (SELECT * FROM keys WHERE src <> 'S1' QUALIFY row_number() OVER (PARTITION BY src, country, channel, key ORDER BY row_idx, entity_id) <= CASE channel {case} END)"""


PAIRS = """prs AS (SELECT a.row_idx AS s1_idx, a.entity_id AS s1_id, b.row_idx AS cand_idx, b.entity_id AS cand_id, channel
  FROM (SELECT * FROM keys WHERE src = 'S1') a JOIN capped b USING (country, channel, key)),
cand AS (SELECT s1_idx, s1_id, cand_idx, cand_id, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels FROM prs GROUP BY ALL)"""

TRUTH = """tails AS (SELECT 'S' || (doc_id % 3 + 1) AS src, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, doc_id AS row_idx, coalesce(lang, '') AS lang, right(text, 80) AS tail FROM documents),
gt AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM tails a JOIN tails b USING (lang, tail) WHERE a.src = 'S1' AND b.src <> 'S1'),
gl AS (SELECT row_idx, entity_id AS s1_id, coalesce(ids, []) AS ids FROM (SELECT * FROM tails WHERE src = 'S1') LEFT JOIN (SELECT s1_id AS entity_id, list(cand_id) AS ids FROM gt GROUP BY 1) USING (entity_id)),
kinds AS (SELECT *, len(list_filter(ids, lambda x: starts_with(x, 'S2-'))) AS k2, len(list_filter(ids, lambda x: starts_with(x, 'S3-'))) AS k3 FROM gl)"""
KIND = "CASE WHEN k2 > 0 AND k3 > 0 THEN 'S2+S3' WHEN k2 > 0 THEN 'S2-only' WHEN k3 > 0 THEN 'S3-only' ELSE 'None' END"

SIZES = """sizes AS (SELECT count(*) FILTER (src = 'S1') AS n_s1, count(*) FILTER (src = 'S1') * count(*) FILTER (src <> 'S1') AS max_pairs FROM ent)"""
RATES = """hits::DOUBLE / nullif(gt_pairs, 0) AS recall, candidates::DOUBLE / nullif(n_s1, 0) AS avg_candidates, 1.0::DOUBLE - candidates::DOUBLE / nullif(max_pairs, 0) AS reduction"""


def with_(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


def union_parts(config: LinkageConfig | None = None) -> tuple[str, ...]:
    config = config or LinkageConfig()
    return ENT, keys(config.df_ceiling), caps(config.caps), PAIRS


def channel_metrics(values: dict[str, int] | None, channels: str = "") -> str:
    right = caps(values) if values else "capped AS (SELECT * FROM keys WHERE src <> 'S1')"
    return with_(ENT, keys(), right, TRUTH, SIZES, select=f"""SELECT channel, candidates, hits, gt_pairs, n_s1, max_pairs, {RATES} FROM (
  SELECT channel, coalesce(c.n, 0)::BIGINT AS candidates, coalesce(h.n, 0)::BIGINT AS hits, (SELECT count(*) FROM gt) AS gt_pairs, n_s1, max_pairs
  FROM (SELECT DISTINCT channel FROM keys {channels}) LEFT JOIN (SELECT channel, count(*) AS n FROM (SELECT * FROM keys WHERE src = 'S1') a JOIN capped b USING (country, channel, key) GROUP BY 1) c USING (channel)
  LEFT JOIN (SELECT a.channel, count(*) AS n FROM gt JOIN keys a ON a.entity_id = s1_id JOIN capped b ON b.entity_id = cand_id AND a.country = b.country AND a.channel = b.channel AND a.key = b.key GROUP BY 1) h USING (channel), sizes)""")


def union_metrics(config: LinkageConfig | None = None) -> str:
    return with_(*union_parts(config), TRUTH, SIZES, select=f"""SELECT candidates, hits, gt_pairs, n_s1, max_pairs, {RATES} FROM (
  SELECT (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM cand SEMI JOIN gt USING (s1_id, cand_id)) AS hits, (SELECT count(*) FROM gt) AS gt_pairs, n_s1, max_pairs FROM sizes)""")


NOVEL = """base AS (SELECT s1_id, cand_id FROM gt JOIN keys a ON a.entity_id = s1_id AND a.channel = 'exact_name' JOIN keys b ON b.entity_id = cand_id AND b.channel = 'exact_name' AND a.country = b.country AND a.key = b.key),
novel AS (SELECT cand.* FROM cand SEMI JOIN gt USING (s1_id, cand_id) ANTI JOIN base USING (s1_id, cand_id))"""


def _grams(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) END"


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both}::DOUBLE / nullif(len({a}) + len({b}) - {both}, 0), 0)"


def _seq(a: str, b: str) -> str:
    shared = " + ".join(f"least(length({a}) - length(replace({a}, '{c}', '')), length({b}) - length(replace({b}, '{c}', '')))" for c in ALPHABET)
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) < 0.2 THEN 0.0 ELSE (2 * ({shared}))::DOUBLE / (length({a}) + length({b})) END"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(least(length({a}), length({b}))::DOUBLE / nullif(greatest(length({a}), length({b})), 0), 0)"


def features(flags: bool) -> str:
    """Columns over ``a`` and ``b`` (rows of ``rec``); ``flags``: provenance from the candidate's ``channels``."""
    same = lambda n: f"(a.{n} <> '' AND a.{n} = b.{n})"
    if flags:
        p = [f"list_contains(string_split(channels, ','), '{c}')" for c in ("exact_name", "sorted_name", "first2_tokens", "address_key", "rare_token")]
    else:
        p = [same("norm_name"), same("sorted_name"), same("first2_name"), same("addr_num_street"), "len(list_intersect(a.core, b.core)) > 0"]
    both = "(a.has AND b.has)"
    at = lambda x: f"CASE WHEN {both} THEN {x} ELSE 0 END"
    small = lambda x, y: f"coalesce(len(list_intersect({x}, {y}))::DOUBLE / nullif(least(len({x}), len({y})), 0), 0)"
    cols = {
        "country_match": same("c"), "is_s3": "starts_with(cand_id, 'S3-')", "name_jaccard": _jac("a.ns", "b.ns"), "name_overlap_min": small("a.ns", "b.ns"),
        "name_token_intersection": "len(list_intersect(a.ns, b.ns))", "name_3gram_jaccard": _jac("a.ng", "b.ng"),
        "name_seq_ratio": f"CASE WHEN len(list_intersect(a.ng, b.ng)) = 0 AND len(list_intersect(a.ns, b.ns)) = 0 THEN 0.0 ELSE {_seq('a.norm_name', 'b.norm_name')} END",
        "first_char_match": "(a.norm_name <> '' AND left(a.norm_name, 1) = left(b.norm_name, 1))",
        "prefix_3_match": "(length(a.norm_name) >= 3 AND length(b.norm_name) >= 3 AND left(a.norm_name, 3) = left(b.norm_name, 3))",
        "name_len_diff": "abs(length(a.norm_name) - length(b.norm_name))", "name_len_ratio": _ratio("a.norm_name", "b.norm_name"),
        "s1_has_addr": "a.has", "cand_has_addr": "b.has", "both_has_addr": both, "addr_jaccard": at(_jac("a.as_", "b.as_")), "addr_overlap_min": at(small("a.as_", "b.as_")),
        "addr_seq_ratio": at(f"CASE WHEN len(list_intersect(a.as_, b.as_)) = 0 THEN 0.0 ELSE {_seq('a.norm_addr', 'b.norm_addr')} END"),
        "num_exact_match": at("coalesce((a.nums_raw[1] = b.nums_raw[1])::INT, 0)"), "num_jaccard": at(_jac("a.nset", "b.nset")),
        "addr_len_diff": at("abs(length(a.norm_addr) - length(b.norm_addr))"), "addr_len_ratio": at(_ratio("a.norm_addr", "b.norm_addr")),
        **dict(zip(("p_exact", "p_sort", "p_f2", "p_addr", "p_rare"), p, strict=True)), "p_channel_count": " + ".join(f"({x})::INT" for x in p),
    }
    return ", ".join(f"({x})::DOUBLE AS {n}" for n, x in cols.items())


REC = f"""rec AS (SELECT entity_id, norm_name, norm_addr, sorted_name, first2_name, addr_num_street, list_distinct(core) AS core, coalesce(country, '') AS c, (norm_addr <> '' AND norm_addr <> 'none') AS has,
  list_distinct(nt) AS ns, {_grams('norm_name')} AS ng, list_distinct(ad) AS as_, regexp_extract_all(coalesce(business_address, ''), '\\b[0-9]+\\b') AS nums_raw,
  list_distinct(regexp_extract_all(coalesce(business_address, ''), '\\b[0-9]+\\b')) AS nset FROM keyed)"""
FROM_PAIRS = "JOIN rec a ON a.entity_id = s1_id JOIN rec b ON b.entity_id = cand_id"
VAL = "('0x' || substr(md5(s1_id), 1, 8))::BIGINT % 5 = 0"
SAMPLE = """lab AS (SELECT cand.*, (gt.s1_id IS NOT NULL)::INT AS label FROM cand LEFT JOIN gt USING (s1_id, cand_id)),
samp AS (SELECT * FROM lab QUALIFY label = 1 OR row_number() OVER (PARTITION BY s1_id, label ORDER BY cand_idx, cand_id) <= 3)"""


def sampled_features(select: str) -> str:
    return with_(*union_parts(), TRUTH, REC, SAMPLE, f"feat AS (SELECT s1_id, cand_id, label, {features(False)} FROM samp {FROM_PAIRS})", select=select)


def sweep(source: str) -> str:
    steps = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(THRESHOLDS))
    return f"""(SELECT step, threshold, tp, fp, fn, coalesce(1.25::DOUBLE * tp / nullif(1.25::DOUBLE * tp + 0.25::DOUBLE * fn + fp, 0), 0) AS f05 FROM (
  SELECT step, threshold, count(*) FILTER (prob >= threshold AND label = 1) AS tp, count(*) FILTER (prob >= threshold AND label = 0) AS fp, count(*) FILTER (prob < threshold AND label = 1) AS fn
  FROM {source}, (VALUES {steps}) v(step, threshold) GROUP BY 1, 2))"""


def address(x: str) -> str:
    out = norm(x)
    for short, long in ADDRESS_WORDS.items():
        out = f"regexp_replace({out}, '\\b{short}\\b', '{long}', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


SINGLE = SINGLE_CAPS
