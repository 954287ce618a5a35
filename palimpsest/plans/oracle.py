"""DuckDB SQL of the engine's queries, written apart from the Spark plans."""

from __future__ import annotations

from palimpsest.functions.hashing import WORD_MULTIPLIER
from palimpsest.plans.constants import COST_WINDOWS, FIXED_JUMP, MAX_BLOCK, MAX_TOKENS, MAX_VERSION, SWEEP, TREE_JUMP, WINDOWS

_SPLIT = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"

DOCS = f"docs AS (SELECT doc_id, {_SPLIT} AS toks FROM documents)"
CONV = f"vers AS (SELECT conv_id AS collection, turn AS version, {_SPLIT} AS toks FROM conversations)"
VERS = (
    DOCS
    + """, keyed AS (
  SELECT doc_id, toks, CASE WHEN len(toks) >= 10
    THEN list_min(list_transform(range(0, len(toks) - 9), lambda i: md5(array_to_string(toks[i + 1 : i + 10], ' '))))
    ELSE md5(array_to_string(toks, ' ')) END AS collection FROM docs
), vers AS (
  SELECT collection, row_number() OVER (PARTITION BY collection ORDER BY doc_id) - 1 AS version, doc_id, toks FROM keyed
)"""
)
TOK = "tok AS (SELECT doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM docs)"
VTOK = "tok AS (SELECT collection, version, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM vers)"

# one step of the word hash per common table
HASHED = f"""h0 AS (SELECT *, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS wid FROM tok),
h1 AS (SELECT *, xor(wid, wid >> 15) AS k1 FROM h0),
h2 AS (SELECT *, (4294967295 - k1 + (k1 << 6)) & 4294967295 AS k2 FROM h1),
h3 AS (SELECT *, xor(k2, k2 >> 4) AS k3 FROM h2),
h4 AS (SELECT *, CAST((CAST(k3 AS HUGEINT) * {WORD_MULTIPLIER}) % 4294967296 AS BIGINT) AS k4 FROM h3),
hashed AS (SELECT * EXCLUDE (k1, k2, k3, k4), xor(k4, k4 >> 16) >> 24 AS b FROM h4)"""


def _nested() -> str:
    row, sums = [1] * 10, []
    for level in range(4):
        terms = " + ".join(f"{c} * lead(b, {k}) OVER w" for k, c in enumerate(row))
        sums.append(f"((({terms}) % 256) << {8 * level})")
        row = [sum(row[k:]) for k in range(10)]
    return " + ".join(sums)


GRAMS = (
    HASHED
    + f""",
g0 AS (SELECT collection, version, pos, {_nested()} AS h, count(*) OVER (PARTITION BY collection, version) AS n
       FROM hashed WINDOW w AS (PARTITION BY collection, version ORDER BY pos)),
grams AS (SELECT collection, version, pos, h FROM g0 WHERE n > 10 AND pos <= n - 10)"""
)
FREQ = """f0 AS (SELECT *, count(*) OVER (PARTITION BY collection, h) AS freq FROM grams),
freq AS (SELECT *, coalesce(lead(freq) OVER (PARTITION BY collection, version ORDER BY pos) - freq, 0) AS diff FROM f0)"""


def winnow(w: int, name: str = "bounds") -> str:
    return f"""m_{name} AS (SELECT collection, version, pos, -min(struct_pack(h := h, neg := -pos)) OVER (PARTITION BY collection, version ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING).neg AS place,
  count(*) OVER (PARTITION BY collection, version) AS n FROM grams),
{name} AS (SELECT DISTINCT collection, version, place AS pos FROM m_{name} WHERE pos BETWEEN 1 AND n - {w}
  UNION SELECT collection, version, 0 FROM vers WHERE len(toks) > 0)"""


def blocks(bounds: str = "bounds", name: str = "blocks") -> str:
    return f"""{name} AS (SELECT b.collection, b.version, row_number() OVER w - 1 AS idx, b.pos AS "start", coalesce(lead(b.pos) OVER w, len(v.toks)) AS "end",
  v.toks FROM {bounds} b JOIN vers v USING (collection, version) WHERE len(v.toks) > 0 WINDOW w AS (PARTITION BY b.collection, b.version ORDER BY b.pos))"""


def fragments(blocks: str = "blocks", name: str = "frags") -> str:
    return f"""{name} AS (SELECT collection, version, idx, "start", "end" - "start" AS len, md5(array_to_string(toks["start" + 1 : "end"], ' ')) AS hash FROM {blocks})"""


def tradeoff(windows) -> str:
    parts, rows = [], []
    for w in windows:
        parts += [winnow(w, f"bo{w}"), blocks(f"bo{w}", f"bl{w}"), fragments(f"bl{w}", f"fr{w}")]
        rows.append(f"SELECT collection, {w}.0::DOUBLE AS w, count(*) AS n_apps, count(DISTINCT hash) AS n_frags, sum(CASE WHEN rn = 1 THEN len ELSE 0 END)::BIGINT AS n_postings FROM (SELECT *, row_number() OVER (PARTITION BY collection, hash ORDER BY version, \"start\") AS rn FROM fr{w}) GROUP BY collection")
    return ", ".join(parts) + ", trade AS (" + " UNION ALL ".join(rows) + ")"


def cells(source: str, name: str) -> str:
    """Blocks dealt to the cells of 64 positions that they touch, so that joins of blocks have an equality key."""
    return f"""{name} AS MATERIALIZED (SELECT *, unnest(range("start" // 64, ("end" - 1) // 64 + 1)) AS cell FROM {source})"""


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def recursive(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


_WID = "CAST('0x' || substr(md5(t), 1, 8) AS BIGINT)"
_SWEEP = ", ".join(map(str, SWEEP))
#: Documents per index block.
BLOCK = 4096


def postings(place: str, block: str, order: str, source: str = "tok") -> str:
    """Digests of the posting lists of (term, block)."""
    return f"SELECT term, {block} AS block, count(*) AS freq, count(DISTINCT {order}) AS n_docs, md5(string_agg({place} || ':' || pos, ' ' ORDER BY {order}, pos)) AS postings FROM {source} GROUP BY 1, 2"


def levels(total: int, name: str = "lev") -> str:
    """Candidate blocks of sliding merges: level k joins k + 1 blocks that follow each other."""
    parts = [f'SELECT collection, version, {k} AS level, idx, "start", lead("end", {k}) OVER w AS "end", toks FROM blocks WINDOW w AS (PARTITION BY collection, version ORDER BY idx) QUALIFY lead("end", {k}) OVER w IS NOT NULL' for k in range(total + 1)]
    return f"{name} AS (" + " UNION ALL ".join(f"({p})" for p in parts) + ")"


def chains(source: str, id: str) -> tuple[str, ...]:
    """Fragments that stand side by side wherever they stand, walked from the head of each chain."""
    return (
        f"""placed AS MATERIALIZED (SELECT collection, {id} AS id, version, "start" AS o, len FROM {source})""",
        "counted AS MATERIALIZED (SELECT collection, id, count(*) AS n FROM placed GROUP BY ALL)",
        """pair AS MATERIALIZED (SELECT a.collection, a.id AS l, b.id AS r FROM placed a JOIN placed b ON a.collection = b.collection AND a.version = b.version AND a.o + a.len = b.o
  JOIN counted na ON na.collection = a.collection AND na.id = a.id JOIN counted nb ON nb.collection = b.collection AND nb.id = b.id
  GROUP BY a.collection, a.id, b.id, na.n, nb.n HAVING count(*) = na.n AND count(*) = nb.n)""",
        """chain AS (SELECT collection, id AS head, id, 0 AS rank FROM counted WHERE (collection, id) NOT IN (SELECT (collection, r) FROM pair)
  UNION ALL SELECT c.collection, c.head, p.r, c.rank + 1 FROM chain c JOIN pair p ON p.collection = c.collection AND p.l = c.id)""",
    )


def greedy_cover(weights) -> tuple[str, ...]:
    """The greedy cover of the blocks in lev, one fragment per collection and weight in each step of a recursion."""
    return (
        """cand AS MATERIALIZED (SELECT DISTINCT collection, version, "start" AS o, "end" - "start" AS len, md5(array_to_string(toks["start" + 1 : "end"], ' ')) AS hash FROM lev)""",
        # places of one fragment that overlap an earlier one of its own don't count
        """own AS MATERIALIZED (SELECT collection, hash, len, version, unnest(list_reduce([[]::BIGINT[]] || list([o, len]::BIGINT[] ORDER BY o), lambda acc, x:
  CASE WHEN len(acc) = 0 OR x[1] >= acc[len(acc)] + x[2] THEN list_concat(acc, x[1:1]) ELSE acc END)) AS o FROM cand GROUP BY collection, hash, len, version)""",
        f"weights AS (SELECT unnest([{', '.join(map(str, weights))}])::DOUBLE AS w)",
        """run AS (SELECT w, 0 AS k, false AS taken, collection, hash, len, version, o FROM own CROSS JOIN weights
  UNION ALL (
    WITH live AS MATERIALIZED (SELECT * FROM run WHERE NOT taken),
    frag AS (SELECT w, collection, hash, any_value(len) AS len, count(*) AS size, min({'v': version, 'o': o}) AS first FROM live GROUP BY w, collection, hash),
    best AS (SELECT w, collection, arg_min(hash, (-(len * size)::DOUBLE / ((1 + len)::DOUBLE + w * (1 + size)::DOUBLE), first, len, hash)) AS hash FROM frag GROUP BY w, collection),
    now AS MATERIALIZED (SELECT live.* FROM live JOIN best USING (w, collection, hash))
    SELECT w, k + 1, true, collection, hash, len, version, o FROM now
    UNION ALL
    SELECT w, k + 1, false, collection, hash, len, version, o FROM live l WHERE NOT EXISTS (
      SELECT 1 FROM now c WHERE c.w = l.w AND c.collection = l.collection AND c.version = l.version AND l.o < c.o + c.len AND c.o < l.o + l.len)))""",
        """chosen AS MATERIALIZED (SELECT w, k - 1 AS rank, collection, hash, any_value(len) AS len, count(*) AS size, min({'v': version, 'o': o}) AS first FROM run WHERE taken GROUP BY w, k, collection, hash)""",
    )


def jump_cut(relative: bool, max_block: int = 0) -> tuple[str, ...]:
    """Boundaries at frequency jumps, strongest first, none within 10 of an accepted one; then long blocks refined."""
    d = "CAST(trunc((freq - nxt) / least(freq, nxt)) AS BIGINT)" if relative else "freq - nxt"
    parts = [
        "ahead AS (SELECT collection, version, pos, freq, lead(freq) OVER (PARTITION BY collection, version ORDER BY pos) AS nxt FROM freq)",
        f"jump AS (SELECT collection, version, pos, {d} AS d FROM ahead WHERE nxt IS NOT NULL)",
        "cand AS (SELECT collection, version, abs(d) AS size, CASE WHEN d > 0 THEN pos + 10 ELSE pos + 1 END AS p FROM jump WHERE abs(d) > 1)",
        """chosen AS (SELECT collection, version, list_reduce([[]::BIGINT[]] || list([p::BIGINT] ORDER BY size DESC, p), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda q: q >= x[1] - 10 AND q < x[1] + 10)) = 0 THEN list_concat(acc, x) ELSE acc END) AS ps
FROM cand JOIN vers USING (collection, version) WHERE p < len(toks) GROUP BY collection, version)""",
        "jb AS (SELECT collection, version, unnest(ps) AS pos FROM chosen UNION SELECT collection, version, 0 FROM vers WHERE len(toks) > 0)",
    ]
    if max_block:
        parts += [
            "gap AS (SELECT collection, version, pos AS a, coalesce(lead(pos) OVER (PARTITION BY collection, version ORDER BY pos), len(toks)) AS b FROM jb JOIN vers USING (collection, version))",
            """low AS (SELECT collection, version, pos, freq, h < min(h) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AND h < min(h) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS least,
  count(*) OVER (PARTITION BY collection, version) AS n FROM freq WINDOW w AS (PARTITION BY collection, version ORDER BY pos))""",
            f"more AS (SELECT collection, version, pos FROM gap JOIN low USING (collection, version) WHERE b - a > {max_block} AND pos > a + 10 AND pos < b - 10 AND least AND pos >= 10 AND pos + 10 < n AND freq > 1)",
        ]
    return tuple(parts)


#: The window of least cost of each collection, its fragments, and their global ids.
CHOSEN = """best AS (SELECT collection, w FROM trade QUALIFY row_number() OVER (PARTITION BY collection ORDER BY 2 * n_postings + 2 * n_frags + 2 * n_apps, w) = 1),
own AS (SELECT f.* FROM (""" + " UNION ALL ".join(f"SELECT {w}.0::DOUBLE AS w, * FROM fr{w}" for w in WINDOWS) + """) f JOIN best USING (collection, w)),
firsts AS (SELECT collection, hash, any_value(len) AS len, count(*) AS size, min(struct_pack(v := version, o := "start")) AS f FROM own GROUP BY collection, hash),
named AS (SELECT *, row_number() OVER (ORDER BY collection, f.v, f.o) - 1 AS frag_id FROM firsts),
apps AS (SELECT frag_id, collection, version, n.len, "start" AS "offset" FROM own JOIN named n USING (collection, hash)),
ftok AS (SELECT frag_id, unnest(toks[f.o + 1 : f.o + len]) AS term, unnest(range(len)) AS pos FROM named JOIN vers ON vers.collection = named.collection AND vers.version = f.v)"""

BASE = (VERS, VTOK, GRAMS)
TRADE = (*BASE, tradeoff(WINDOWS))
_CUT = (*BASE, winnow(20), blocks(), fragments())
#: Refining levels: a level cuts where its own window or a coarser one does.
_TREE = (
    *BASE,
    *(winnow(w, f"b{w}") for w in WINDOWS),
    *(f"u{k} AS (" + " UNION ".join(f"SELECT collection, version, pos FROM b{w}" for w in WINDOWS[k:]) + ")" for k in range(len(WINDOWS))),
    *(blocks(f"u{k}", f"t{k}") for k in range(len(WINDOWS))),
    "tree AS MATERIALIZED (" + " UNION ALL ".join(f'SELECT collection, version, {k} AS level, idx, "start", "end" FROM t{k}' for k in range(len(WINDOWS))) + ")",
)
#: Frontier rows by number, their steps with the worst rate so far, and the budget.
_FRONTIER = (
    "front AS (SELECT collection, w, n_apps, n_postings FROM (SELECT *, min(n_postings) OVER (PARTITION BY collection ORDER BY n_apps, n_postings, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM trade) WHERE least IS NULL OR n_postings < least)",
    "rowed AS (SELECT *, dense_rank() OVER (ORDER BY collection) AS d, row_number() OVER (PARTITION BY collection ORDER BY n_apps) AS k FROM front)",
    "limits AS (SELECT sum(n_apps)::BIGINT AS least, (sum(n_apps) * 3 // 2)::BIGINT AS budget FROM rowed WHERE k = 1)",
    "step0 AS (SELECT *, n_apps - lag(n_apps) OVER w AS apps, lag(n_postings) OVER w - n_postings AS saved FROM rowed WINDOW w AS (PARTITION BY collection ORDER BY n_apps))",
    "stepped AS (SELECT *, min(saved / apps) OVER (PARTITION BY collection ORDER BY n_apps) AS worst FROM step0 WHERE apps IS NOT NULL)",
)

ORACLE_SQL = {
    "scan_documents": sql(DOCS, select="SELECT doc_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS content FROM docs"),
    "collections": sql(VERS, select="SELECT collection, version, doc_id, len(toks) AS n_tokens FROM vers"),
    "version_counts": sql(VERS, select="SELECT collection, count(*) AS n_versions FROM vers GROUP BY collection"),
    "version_lengths": sql(CONV, select="SELECT collection, version, len(toks) AS n_tokens FROM vers"),
    "catalog_lookup": sql(CONV, select="SELECT collection, count(*) AS n_versions FROM vers WHERE collection IN (0, 7, 11, 99999) GROUP BY collection"),
    "doc_sizes": sql(VERS, select="SELECT collection, CAST(sum(len(toks)) AS BIGINT) AS n_tokens FROM vers GROUP BY collection"),
    "doc_count": sql(VERS, select="SELECT count(DISTINCT collection) AS n_collections, count(*) AS n_versions, CAST(sum(len(toks)) AS BIGINT) AS n_postings FROM vers"),
    "vocabulary": sql(DOCS, TOK, select="SELECT term, count(*) AS freq, dense_rank() OVER (ORDER BY term) - 1 AS term_id FROM tok GROUP BY term"),
    "posting_decode": sql(CONV, VTOK, select="SELECT collection, version, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS wid, pos FROM tok"),
    "word_hash": sql(DOCS, TOK, HASHED, select="SELECT DISTINCT wid, b FROM hashed"),
    "content_hash": sql(DOCS, select="SELECT md5(array_to_string(toks, ' ')) AS content, count(*) AS n, min(doc_id) AS first_doc FROM docs GROUP BY 1"),
    "ngram_hash": sql(*BASE, select="SELECT collection, version, count(*) AS n, CAST(sum(h) AS BIGINT) AS sum_h, min(h) AS min_h, max(h) AS max_h FROM grams GROUP BY collection, version"),
    "ngram_hash_positions": sql(CONV, VTOK, GRAMS, select="SELECT collection, version, pos, h FROM grams"),
    "ngram_freq": sql(*BASE, FREQ, select="SELECT collection, version, pos, freq, diff FROM freq WHERE freq > 1 OR diff <> 0"),
    "winnow_boundaries": sql(*BASE, winnow(20), select="SELECT collection, version, pos FROM bounds"),
    "dominance_radius": sql(
        CONV, VTOK, GRAMS,
        select="""SELECT a.collection, a.version, a.pos, greatest(0, least(a.pos - coalesce(max(CASE WHEN b.pos < a.pos THEN b.pos END), -1),
          coalesce(min(CASE WHEN b.pos > a.pos THEN b.pos END), any_value(n.n)) - a.pos) - 1) AS radius
FROM grams a JOIN (SELECT collection, version, count(*) AS n FROM grams GROUP BY ALL) n USING (collection, version)
LEFT JOIN grams b ON a.collection = b.collection AND a.version = b.version AND b.h <= a.h AND b.pos <> a.pos
GROUP BY a.collection, a.version, a.pos""",
    ),
    "cut_threshold": sql(
        CONV, VTOK, GRAMS,
        select="""SELECT collection, version, pos FROM (
SELECT a.collection, a.version, a.pos, greatest(0, least(a.pos - coalesce(max(CASE WHEN b.pos < a.pos THEN b.pos END), -1),
          coalesce(min(CASE WHEN b.pos > a.pos THEN b.pos END), any_value(n.n)) - a.pos) - 1) AS radius, any_value(n.n) + 9 AS len
FROM grams a JOIN (SELECT collection, version, count(*) AS n FROM grams GROUP BY ALL) n USING (collection, version)
LEFT JOIN grams b ON a.collection = b.collection AND a.version = b.version AND b.h <= a.h AND b.pos <> a.pos
GROUP BY a.collection, a.version, a.pos) WHERE radius >= 5 AND pos <= len - 14
UNION SELECT collection, version, 0 FROM vers WHERE len(toks) > 0""",
    ),
    "cut_tree": sql(
        VERS, VTOK, GRAMS, FREQ,
        select=f"""SELECT collection, version, pos FROM (SELECT collection, version, pos + 10 AS pos, abs(lead(freq) OVER (PARTITION BY collection, version ORDER BY pos) - freq) AS gap FROM freq) WHERE gap >= {TREE_JUMP}
UNION SELECT collection, version, 0 FROM grams""",
    ),
    "level_merge": sql(
        *_CUT,
        select="""SELECT collection, version, idx, "start", lead("end") OVER w AS "end" FROM blocks WINDOW w AS (PARTITION BY collection, version ORDER BY idx)
QUALIFY lead("end") OVER w IS NOT NULL""",
    ),
    "level_merge_skip": sql(
        *_CUT,
        select="""SELECT collection, version, idx // 2 AS idx, "start", lead("end", 2) OVER w AS "end" FROM blocks WINDOW w AS (PARTITION BY collection, version ORDER BY idx)
QUALIFY lead("end", 2) OVER w IS NOT NULL AND idx % 2 = 0""",
    ),
    "hierarchy": sql(
        *_CUT,
        select="""SELECT c.collection, c.version, c.idx, p.idx AS parent FROM blocks c JOIN (
  SELECT collection, version, idx, "start", lead("end") OVER (PARTITION BY collection, version ORDER BY idx) AS "end" FROM blocks) p
ON c.collection = p.collection AND c.version = p.version AND p."start" <= c."start" AND p."end" >= c."end" """,
    ),
    "cut_histogram": sql(
        *_CUT,
        select="""SELECT "end" - "start" AS length, count(*) AS n FROM (SELECT *, max(idx) OVER (PARTITION BY collection, version) AS last FROM blocks) WHERE idx < last GROUP BY 1""",
    ),
    "compare_cutters": sql(
        *BASE, winnow(20, "x"), winnow(40, "y"),
        select="""SELECT collection, version, a.n AS n_first, b.n AS n_second FROM (SELECT collection, version, count(*) AS n FROM x GROUP BY ALL) a
JOIN (SELECT collection, version, count(*) AS n FROM y GROUP BY ALL) b USING (collection, version) WHERE a.n > b.n""",
    ),
    "fragment_dict": sql(*_CUT, select="SELECT collection, hash, any_value(len) AS len, count(*) AS size FROM frags GROUP BY collection, hash"),
    "fragment_scores": sql(
        *_CUT,
        select="""SELECT collection, hash, round(len * size / (1 + len + 10.0 * (1 + size)), 6) AS score, round(len * size / (1 + 10.0 * (1 + size)), 6) AS grammar_score
FROM (SELECT collection, hash, CAST(any_value(len) AS DOUBLE) AS len, CAST(count(*) AS DOUBLE) AS size FROM frags GROUP BY collection, hash)""",
    ),
    "overlap_pairs": sql(
        *_CUT,
        """pair AS MATERIALIZED (SELECT collection, version, idx * 2 AS id, "start", "end" FROM blocks UNION ALL
  SELECT collection, version, idx * 2 + 1, "start", e FROM (SELECT *, lead("end") OVER (PARTITION BY collection, version ORDER BY idx) AS e FROM blocks) WHERE e IS NOT NULL)""",
        cells("pair", "dealt"),
        select="""SELECT a.collection, a.version, a.id AS a, b.id AS b FROM dealt a JOIN dealt b ON a.collection = b.collection AND a.version = b.version AND a.cell = b.cell
WHERE a.id < b.id AND a."start" < b."end" AND b."start" < a."end" AND a.cell = greatest(a."start", b."start") // 64""",
    ),
    "select_cover_totals": recursive(
        *_CUT, levels(3), *greedy_cover([1.0]),
        select="""SELECT collection, sum(size)::BIGINT AS n_apps, count(*) AS n_frags, sum(len)::BIGINT AS n_postings, sum(size * len)::BIGINT AS covered, CAST(0 AS BIGINT) AS faults FROM chosen GROUP BY collection""",
    ),
    "round_trip": sql(VERS, select="SELECT collection, version, md5(array_to_string(toks, ' ')) AS content FROM vers WHERE len(toks) > 0"),
    "tradeoff_windows": sql(*TRADE, select="SELECT * FROM trade"),
    "best_window": sql(*TRADE, select="SELECT collection, w, 2 * n_postings + 2 * n_frags + 2 * n_apps AS cost FROM trade QUALIFY row_number() OVER (PARTITION BY collection ORDER BY 2 * n_postings + 2 * n_frags + 2 * n_apps, w) = 1"),
    "pareto_frontier": sql(*TRADE, select="SELECT collection, w, n_apps, n_frags, n_postings FROM (SELECT *, min(n_postings) OVER (PARTITION BY collection ORDER BY n_apps, n_postings, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM trade) WHERE least IS NULL OR n_postings < least"),
    "unchanged_collections": sql(*TRADE, select="SELECT collection, min(n_postings) AS n_postings FROM trade GROUP BY collection HAVING min(n_postings) = max(n_postings)"),
    "valid_steps": sql(*TRADE, select="SELECT a.collection, a.w AS w_from, b.w AS w_to, b.n_apps - a.n_apps AS apps, a.n_postings - b.n_postings AS saved FROM trade a JOIN trade b ON a.collection = b.collection AND b.n_apps > a.n_apps AND b.n_postings < a.n_postings"),
    "compare_methods": sql(*TRADE, select="SELECT collection, a.n_apps AS first_apps, b.n_apps AS second_apps FROM (SELECT * FROM trade WHERE w = 40) a JOIN (SELECT * FROM trade WHERE w = 5) b USING (collection) WHERE a.n_apps < b.n_apps"),
    "reduction": sql(*TRADE, select="SELECT w, CAST(sum(n_postings) AS BIGINT) AS after, CAST(sum(total) AS BIGINT) AS before, round(sum(n_postings) / sum(total), 6) AS ratio FROM trade JOIN (SELECT collection, sum(len(toks)) AS total FROM vers GROUP BY collection) USING (collection) GROUP BY w"),
    "chosen_or_default": sql(*TRADE, select="SELECT collection, coalesce(c.w, 1.0)::DOUBLE AS w FROM (SELECT DISTINCT collection FROM vers) LEFT JOIN (SELECT collection, min(w) AS w FROM trade WHERE n_apps > 3 GROUP BY collection) c USING (collection)"),
    "first_postings": sql(
        *_CUT,
        select="""SELECT collection, hash, len, version, "start" AS "offset" FROM frags QUALIFY row_number() OVER (PARTITION BY collection, hash ORDER BY version, "start") = 1""",
    ),
    "prefix_base": sql(CONV, select="SELECT collection, n, coalesce(sum(n) OVER (ORDER BY collection ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT collection, count(*) AS n FROM vers GROUP BY collection)"),
    "inverted_index": sql(DOCS, TOK, select=postings("doc_id", f"doc_id // {BLOCK}", "doc_id")),
    "lexicon": sql(DOCS, TOK, select=f"SELECT term, count(*) AS freq, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id // {BLOCK}) AS n_blocks FROM tok GROUP BY term"),
    "index_file": sql(DOCS, select="SELECT doc_id, md5(array_to_string(toks, ' ')) AS content FROM docs WHERE len(toks) > 0"),
    "index_lists": sql(
        VERS, VTOK, "based AS (SELECT collection, coalesce(sum(n) OVER (ORDER BY collection ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT collection, count(*) AS n FROM vers GROUP BY collection))",
        select=f"SELECT term, (base + version) // {BLOCK} AS block, count(*) AS freq, md5(string_agg(collection || ':' || version || ':' || pos, ' ' ORDER BY collection, version, pos)) AS postings FROM tok JOIN based USING (collection) GROUP BY 1, 2",
    ),
    "index_merge": sql(DOCS, TOK, select=f"SELECT term, doc_id // {BLOCK} AS block, count(*) AS freq, count(DISTINCT doc_id) AS n_docs, md5(string_agg(doc_id || ':' || pos, ' ' ORDER BY doc_id % 3, doc_id, pos)) AS postings FROM tok GROUP BY 1, 2"),
    "forward_restore": sql(DOCS, select="SELECT doc_id, md5(array_to_string(toks, ' ')) AS content FROM docs WHERE len(toks) > 0"),
    "version_fragments": sql(*_CUT, select="SELECT collection, version, md5(string_agg(hash, ' ' ORDER BY hash)) AS fragments, count(*) AS n FROM (SELECT DISTINCT collection, version, hash FROM frags) GROUP BY collection, version"),
    "fused_groups": recursive(
        *_CUT, *chains("frags", "hash"),
        select="SELECT collection, head, id, rank, n FROM (SELECT *, count(*) OVER (PARTITION BY collection, head) AS n FROM chain) WHERE n > 1",
    ),
    "fused_ids": recursive(
        *TRADE, CHOSEN, *chains("(SELECT a.collection, a.version, a.\"offset\" AS \"start\", a.len, a.frag_id FROM (SELECT apps.*, named.collection FROM apps JOIN named USING (frag_id)) a)", "frag_id"),
        """fused AS (SELECT n.collection, c.head, CASE WHEN count(*) = 1 THEN min(n.hash) ELSE md5(string_agg(n.hash, ' ' ORDER BY c.rank)) END AS hash, sum(n.len)::BIGINT AS len, min(n.size) AS size
  FROM named n JOIN chain c ON c.id = n.frag_id GROUP BY n.collection, c.head)""",
        select="SELECT row_number() OVER (ORDER BY head) - 1 AS frag_id, collection, hash, len, size FROM fused",
    ),
    "fused_round_trip": sql(VERS, select="SELECT collection, version, md5(array_to_string(toks, ' ')) AS content FROM vers WHERE len(toks) > 0"),
    "mergeable_fragments": sql(
        *_CUT,
        select="""SELECT collection, a.hash AS left_id, b.hash AS right_id FROM frags a JOIN frags b USING (collection, version)
JOIN (SELECT collection, hash, count(*) AS n FROM frags GROUP BY ALL) na ON na.collection = a.collection AND na.hash = a.hash
JOIN (SELECT collection, hash, count(*) AS n FROM frags GROUP BY ALL) nb ON nb.collection = b.collection AND nb.hash = b.hash
WHERE a."start" + a.len = b."start" GROUP BY collection, a.hash, b.hash, na.n, nb.n HAVING count(*) = na.n AND count(*) = nb.n""".replace("SELECT collection, a.hash", "SELECT a.collection, a.hash").replace("GROUP BY collection, a.hash", "GROUP BY a.collection, a.hash"),
    ),
    "varbyte_sizes": sql(DOCS, select="SELECT doc_id, len(toks) AS n, greatest(1, CAST(ceil(length(bin(len(toks))) / 7.0) AS INTEGER)) AS size FROM docs"),
    "filter_range": "SELECT doc_id, n_chars FROM documents WHERE doc_id BETWEEN 100 AND 299",
    "filter_long_versions": sql(VERS, select="SELECT collection, version, len(toks) AS n_tokens FROM vers WHERE len(toks) > 10"),
    "filter_oversize": sql(VERS, select="SELECT collection, CAST(sum(len(toks)) AS BIGINT) AS n_tokens FROM vers GROUP BY collection HAVING sum(len(toks)) <= 2000"),
    "mark_anomalies": sql(VERS, select="SELECT collection, max(len(toks)) > 2000 AS anomalous FROM vers GROUP BY collection"),
    "single_versions": sql(VERS, select="SELECT collection, 1 AS n_frags, 1 AS n_apps, max(len(toks)) AS n_postings FROM vers GROUP BY collection HAVING count(*) = 1"),
    "equal_versions": sql(VERS, select="SELECT collection, version, min(version) OVER w AS first, count(*) OVER w AS n FROM vers WINDOW w AS (PARTITION BY collection, toks) QUALIFY count(*) OVER w > 1"),
    "sample_docs": "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50",
    "sampled_sizes": sql(DOCS, select="SELECT doc_id, len(toks) AS n_tokens FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "unsampled_sizes": sql(DOCS, select="SELECT doc_id, len(toks) AS n_tokens FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "sweep_grid": sql(VERS, select=f"SELECT collection, w FROM (SELECT DISTINCT collection FROM vers) CROSS JOIN (SELECT unnest([{_SWEEP}])::DOUBLE AS w)"),
    "sweep_list": f"SELECT unnest([{_SWEEP}])::DOUBLE AS w",
    "catalog_tsv": sql(CONV, select="SELECT collection, count(*) AS n_versions FROM vers GROUP BY collection"),
    "corpus_file": sql(VERS, select="SELECT collection, version, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS content FROM vers"),
    "feature_file": sql(*BASE, FREQ, select="SELECT collection, version, count(*) AS n, CAST(sum(freq) AS BIGINT) AS sum_freq, max(freq) AS max_freq, CAST(sum(h) AS BIGINT) AS sum_h FROM freq GROUP BY collection, version"),
    "version_base": sql(VERS, select="SELECT collection, n, coalesce(sum(n) OVER (ORDER BY collection ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT collection, count(*) AS n FROM vers GROUP BY collection)"),
    "ngram_profile": sql(*BASE, select="SELECT collection, CAST(sum(n) AS BIGINT) AS n_grams, count(*) AS n_distinct, max(n) AS max_freq FROM (SELECT collection, h, count(*) AS n FROM grams GROUP BY ALL) GROUP BY collection"),
    "varbyte_low_flag": """WITH num AS (SELECT doc_id, coalesce(length(text), 0) * 1000 + doc_id % 1000 AS n FROM documents), sized AS (SELECT *, greatest(1, CAST(ceil(length(bin(n)) / 7.0) AS INTEGER)) AS size FROM num)
SELECT doc_id, n, array_to_string(list_transform(range(size), lambda k: ((n >> (7 * (size - 1 - k))::INTEGER) & 127) * 2 + CASE WHEN k < size - 1 THEN 1 ELSE 0 END), ' ') AS code, n AS back FROM sized""",
    "varbyte_high_flag": """WITH num AS (SELECT doc_id, coalesce(length(text), 0) * 1000 + doc_id % 1000 AS n FROM documents), sized AS (SELECT *, greatest(1, CAST(ceil(length(bin(n)) / 7.0) AS INTEGER)) AS size FROM num)
SELECT doc_id, n, array_to_string(list_transform(range(size), lambda k: ((n >> (7 * k)::INTEGER) & 127) + CASE WHEN k < size - 1 THEN 128 ELSE 0 END), ' ') AS code, n AS back FROM sized""",
    "bit_fields": sql(DOCS, select="SELECT doc_id, lpad(bin(len(toks)), 20, '0') || lpad(bin(doc_id % 1048576), 20, '0') AS bits, len(toks) || ' ' || (doc_id % 1048576) AS back FROM docs"),
    "cut_jump": sql(*BASE, FREQ, *jump_cut(False, MAX_BLOCK), select="SELECT collection, version, pos FROM jb UNION SELECT collection, version, pos FROM more"),
    "cut_relative_jump": sql(*BASE, FREQ, *jump_cut(True), select="SELECT collection, version, pos FROM jb"),
    "cutters": sql(
        *BASE, FREQ, winnow(20, "x"), winnow(40, "y"),
        select=f"""SELECT 'winnow 20' AS cutter, collection, version, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'winnow 40', collection, version, count(*) FROM y GROUP BY ALL
UNION ALL SELECT 'tree', collection, version, count(*) FROM (SELECT collection, version, pos FROM (SELECT collection, version, pos + 10 AS pos, abs(lead(freq) OVER (PARTITION BY collection, version ORDER BY pos) - freq) AS gap FROM freq) WHERE gap >= {TREE_JUMP}
  UNION SELECT collection, version, 0 FROM grams) GROUP BY ALL""",
    ),
    "overfull_versions": sql(*_CUT, levels(3), select="SELECT collection, version, count(*) AS n FROM lev GROUP BY collection, version HAVING count(*) > 200"),
    "cutter_levels": sql(*_CUT, levels(3), select='SELECT collection, version, level, idx, "start", "end" FROM lev'),
    "cutter_index": sql(
        VERS, VTOK, GRAMS, FREQ,
        f"""bounds AS (SELECT collection, version, pos FROM (SELECT collection, version, pos + 10 AS pos, abs(lead(freq) OVER (PARTITION BY collection, version ORDER BY pos) - freq) AS gap FROM freq) WHERE gap >= {TREE_JUMP}
  UNION SELECT collection, version, 0 FROM vers WHERE len(toks) > 0)""",
        blocks(), fragments(),
        """dict AS (SELECT collection, hash, any_value(len) AS len, count(*) AS size, min({'v': version, 'o': "start"}) AS first FROM frags GROUP BY collection, hash)""",
        select="SELECT row_number() OVER (ORDER BY collection, first) - 1 AS frag_id, collection, hash, len, size FROM dict",
    ),
    "hierarchy_levels": sql(
        *_TREE, cells("tree", "dealt"),
        select="""SELECT c.collection, c.version, c.level, c.idx, c."start", c."end", p.idx AS parent FROM tree c LEFT JOIN (
  SELECT c.collection, c.version, c.level, c.idx AS child, p.idx FROM tree c JOIN dealt p ON p.collection = c.collection AND p.version = c.version AND p.cell = c."start" // 64
  WHERE p.level = c.level + 1 AND p."start" <= c."start" AND p."end" >= c."end") p
ON p.collection = c.collection AND p.version = c.version AND p.level = c.level AND p.child = c.idx""",
    ),
    "tree_conflicts": sql(
        *_TREE, cells("tree", "dealt"),
        """up AS MATERIALIZED (SELECT c.collection, c.version, c.level, c.idx, p.level AS other_level, p.idx AS other_idx FROM tree c JOIN dealt p ON p.collection = c.collection AND p.version = c.version AND p.cell = c."start" // 64
  WHERE p.level > c.level AND p."start" <= c."start" AND p."end" >= c."end")""",
        select="SELECT * FROM up UNION ALL SELECT collection, version, other_level, other_idx, level, idx FROM up",
    ),
    "repair_candidates": sql(VERS, select="SELECT collection, version, CAST(len(toks) AS BIGINT) AS held, CAST(0 AS BIGINT) AS faults FROM vers WHERE len(toks) > 0"),
    "fragment_dict_levels": sql(
        *_CUT, levels(3),
        select="""SELECT collection, hash, any_value(len) AS len, count(*) AS size FROM (SELECT DISTINCT collection, version, "start", "end" - "start" AS len, md5(array_to_string(toks["start" + 1 : "end"], ' ')) AS hash FROM lev) GROUP BY collection, hash""",
    ),
    "select_cover": recursive(*_CUT, levels(3), *greedy_cover([1.0]), select="SELECT collection, rank, hash, len, size, first.v AS version, first.o AS \"offset\", CAST(0 AS BIGINT) AS faults FROM chosen"),
    "select_cover_grammar": sql(VERS, select="SELECT collection, 1.0::DOUBLE AS w, version, CAST(len(toks) AS BIGINT) AS held, CAST(0 AS BIGINT) AS faults FROM vers WHERE len(toks) > 0"),
    "budget_choice": sql(
        *TRADE, *_FRONTIER,
        """plan AS (SELECT list_reduce([[budget - least]] || list([d, apps, k] ORDER BY worst DESC, collection, k), lambda acc, x:
  CASE WHEN list_contains(acc[2:], -x[1]) THEN acc WHEN x[2] <= acc[1] THEN [acc[1] - x[2]] || acc[2:] || [x[1] * 100 + x[3]] ELSE acc || [-x[1]] END) AS acc
  FROM (SELECT s.*, budget, least FROM stepped s CROSS JOIN limits) GROUP BY budget, least),
taken AS (SELECT t // 100 AS d, max(t % 100) AS k FROM (SELECT unnest(acc[2:]) AS t FROM plan) WHERE t > 0 GROUP BY 1)""",
        select="SELECT collection, w FROM rowed LEFT JOIN taken USING (d) WHERE rowed.k = coalesce(taken.k, 1)",
    ),
    "budget_jumps": recursive(
        *TRADE, *_FRONTIER,
        """own AS MATERIALIZED (SELECT d, k, collection, w, n_apps, n_postings FROM rowed)""",
        # one jump in each step: the best of all that fit
        """run AS (SELECT 0 AS i, d, 1 AS k, n_apps, n_postings, budget - least AS rest FROM own CROSS JOIN limits WHERE k = 1
  UNION ALL (
    WITH now AS MATERIALIZED (SELECT * FROM run),
    best AS MATERIALIZED (SELECT s.d, r.k, r.n_apps, r.n_postings, r.n_apps - s.n_apps AS extra FROM now s JOIN own r ON r.d = s.d AND r.k > s.k AND r.n_postings < s.n_postings AND r.n_apps - s.n_apps <= s.rest
      ORDER BY (s.n_postings - r.n_postings)::DOUBLE / (r.n_apps - s.n_apps)::DOUBLE DESC, s.d, r.k LIMIT 1)
    SELECT i + 1, s.d, CASE WHEN s.d = b.d THEN b.k ELSE s.k END, CASE WHEN s.d = b.d THEN b.n_apps ELSE s.n_apps END, CASE WHEN s.d = b.d THEN b.n_postings ELSE s.n_postings END, s.rest - b.extra FROM now s CROSS JOIN best b))""",
        select="SELECT collection, w FROM own JOIN (SELECT d, k FROM run WHERE i = (SELECT max(i) FROM run)) USING (d, k)",
    ),
    "chosen_totals": sql(*TRADE, CHOSEN.split(",\nown")[0], select="SELECT CAST(sum(n_apps) AS BIGINT) AS n_apps, CAST(sum(n_frags) AS BIGINT) AS n_frags, CAST(sum(n_postings) AS BIGINT) AS n_postings FROM trade JOIN best USING (collection, w)"),
    "compare_frontiers": sql(
        *TRADE, FREQ,
        select=f"""SELECT collection, winnow_apps, tree_apps FROM (SELECT collection, min(n_apps) AS winnow_apps FROM trade GROUP BY collection)
JOIN (SELECT collection, count(*) AS tree_apps FROM (SELECT collection, version, pos FROM (SELECT collection, version, pos + 10 AS pos, abs(lead(freq) OVER (PARTITION BY collection, version ORDER BY pos) - freq) AS gap FROM freq) WHERE gap >= {TREE_JUMP}
  UNION SELECT collection, version, 0 FROM grams) GROUP BY collection) USING (collection) WHERE winnow_apps < tree_apps""",
    ),
    "versioned_index": sql(*TRADE, CHOSEN, select=postings("frag_id", f"frag_id // {BLOCK}", "frag_id", "ftok")),
    "fragment_ids": sql(*TRADE, CHOSEN, select="SELECT frag_id, collection, hash, len, size FROM named"),
    "versioned_lookup": sql(VERS, select="SELECT collection, version, i - 1 AS pos FROM (SELECT collection, version, toks, unnest(range(1, len(toks))) AS i FROM vers) WHERE toks[i] = 'of' AND toks[i + 1] = 'the'"),
    "versioned_reduction": sql(*TRADE, CHOSEN, select="SELECT (SELECT CAST(sum(len(toks)) AS BIGINT) FROM vers) AS before, (SELECT CAST(sum(len) AS BIGINT) FROM named) AS after, (SELECT count(*) FROM named) AS n_frags, (SELECT count(*) FROM apps) AS n_apps"),
    "metadata_file": sql(*TRADE, CHOSEN, select='SELECT frag_id, len, version, "offset" FROM apps'),
    "metadata_varbyte": sql(*TRADE, CHOSEN, select='SELECT frag_id, len, version, "offset" FROM apps'),
    "layout_corpus": sql(VERS, select=f"SELECT min(doc_id) OVER (PARTITION BY collection) AS doc, version, len(toks) AS n, md5(array_to_string(list_transform(toks, lambda t: {_WID}), ' ')) AS toks FROM vers"),
    "layout_postings": sql(VERS, select=f"SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY collection) AS doc, version, len(toks) AS n, md5(array_to_string(list_transform(toks, lambda t: {_WID}), ' ')) AS toks FROM vers) WHERE n > 0"),
    "layout_index": sql(DOCS, TOK, select=f"SELECT wid, count(*) AS freq, md5(string_agg(doc_id || ':' || pos, ' ' ORDER BY doc_id, pos)) AS postings FROM (SELECT {_WID} AS wid, doc_id, pos FROM (SELECT term AS t, doc_id, pos FROM tok)) GROUP BY wid"),
    "layout_fragments": sql(*TRADE, CHOSEN, select='SELECT frag_id, len, version, "offset" FROM apps'),
    "lookup_all_terms": sql(DOCS, TOK, select="SELECT doc_id FROM tok WHERE term IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(DISTINCT term) = 3"),
    "lookup_phrase": sql(DOCS, select="SELECT doc_id, i - 1 AS pos FROM (SELECT doc_id, toks, unnest(range(1, len(toks))) AS i FROM docs) WHERE toks[i] = 'of' AND toks[i + 1] = 'the'"),
    "copy_ranges": sql(
        VERS, VTOK,
        """gr AS (SELECT collection, version, pos, term || ' ' || lead(term, 1) OVER w || ' ' || lead(term, 2) OVER w || ' ' || lead(term, 3) OVER w || ' ' || lead(term, 4) OVER w AS g FROM tok WINDOW w AS (PARTITION BY collection, version ORDER BY pos)),
hits AS (SELECT a.collection, a.version, a.pos, r.rpos, a.pos - r.rpos AS diagonal FROM gr a JOIN (SELECT collection, version + 1 AS version, g, min(pos) AS rpos FROM gr WHERE g IS NOT NULL GROUP BY ALL) r USING (collection, version, g)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY collection, version, diagonal ORDER BY pos) AS island FROM hits)""",
        select="SELECT collection, version, min(rpos) AS rstart, min(pos) AS vstart, count(*) + 4 AS len FROM isl GROUP BY collection, version, diagonal, island",
    ),
}
ORACLE_SQL["copy_index"] = ORACLE_SQL["copy_ranges"]
ORACLE_SQL["index_compaction"] = ORACLE_SQL["index_merge"].replace("doc_id % 3", "doc_id % 5")
ORACLE_SQL["radius_file"] = ORACLE_SQL["dominance_radius"]
ORACLE_SQL["radius_parts"] = ORACLE_SQL["dominance_radius"]
ORACLE_SQL["winnow_parts"] = ORACLE_SQL["winnow_boundaries"]
ORACLE_SQL["filter_oversize_fixed"] = ORACLE_SQL["filter_oversize"].replace("<= 2000", f"<= {MAX_TOKENS}")
ORACLE_SQL["mark_anomalies_fixed"] = ORACLE_SQL["mark_anomalies"].replace("> 2000", f"> {MAX_VERSION}")
ORACLE_SQL["cut_tree_fixed"] = ORACLE_SQL["cut_tree"].replace(f"gap >= {TREE_JUMP}", f"gap >= {FIXED_JUMP}")
ORACLE_SQL["best_window_fixed"] = sql(*BASE, tradeoff(COST_WINDOWS), select=ORACLE_SQL["best_window"].rsplit("\n", 1)[1])
