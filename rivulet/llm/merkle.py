"""Merkle manifest of a dataset, with a proof for every row.

Each row is a leaf; the leaves of a group (a lang) ascend by id and fold in runs of
two up to the group's subroot, and the subroots, by group, fold likewise to the
root. A parent is stored as its preimage, the digests of its children joined: a
leaf joins the preimages of its ancestors, and at each level its own 64 characters
cut out of the preimage leave the siblings, while another digest spliced in their
place gives the preimage to fold on.

Levels are built 2**BITS leaves at a time: such a block holds the preimages of all
its levels, blocks are the leaves of the next tier, and a leaf joins one block
that already carries the preimages above it. So a tree over n leaves takes log2(n) /
BITS rounds instead of log2(n), and what is joined is a few hundred bytes a leaf.
Places in a group come from a range sort, so no task holds a group.

Null fields are ``-``, so null and empty differ. A null id or group sorts first and
null groups are one group. Rows that share an id stand in the order of their leaves;
repeated rows are leaves of their own. A lone leaf is its subroot, a lone subroot the
root; a leaf without siblings has an empty proof. An empty table gives no rows. Extra
columns are ignored; a field that the table lacks counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..session import save

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a digest.
WIDTH = 64
BITS = 6
#: One row in so many is tampered with in the report.
TAMPER = 7


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, n, p, h), places p from 0 to n - 1 in each group -> (g, n, p, pre, top), one row a block of 2**BITS places.

    ``pre`` has the preimages of each level inside the block, null beyond the
    group's own height; ``top`` is the digest that is left.
    """
    block = F.shiftright("p", BITS)
    out = nodes.groupBy("g", "n", block.alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x.h).alias("h0"))
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    for k in range(1, BITS + 1):
        run = F.expr(f"transform(sequence(0, (size(h{k - 1}) - 1) div 2), i -> concat(h{k - 1}[2 * i], coalesce(get(h{k - 1}, 2 * i + 1), '')))")
        out = out.withColumn(f"pre{k}", F.when(height >= k, run))
        out = out.withColumn(f"h{k}", F.coalesce(F.transform(f"pre{k}", lambda x: F.sha2(x, 256)), f"h{k - 1}"))
    return out.select("g", "n", F.col("b").alias("p"), F.array(*(f"pre{k}" for k in range(1, BITS + 1))).alias("pre"), F.element_at(f"h{BITS}", 1).alias("top"))


def tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables of blocks, the lowest first; ``most`` is the size of the largest group. The last has a row for each group."""
    out = []
    while True:
        out.append(save(_blocks(nodes), "blocks"))
        if most <= 1 << BITS:
            return out
        most = -(-most // (1 << BITS))
        nodes = out[-1].select("g", F.ceil(F.col("n") / (1 << BITS)).alias("n"), "p", F.col("top").alias("h"))


def _joined(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """nodes with ``path``, the preimages of all their ancestors and their slots in them, and ``top``."""
    kept = [c for c in nodes.columns if c not in ("path", "top")]
    above = blocks.select(F.col("g").alias("_g"), F.col("p").alias("_p"), F.col("pre").alias("_pre"), F.col("path").alias("_path"), F.col("top"))
    own = f"filter(transform(_pre, (level, k) -> struct(get(level, cast(shiftright(p & {(1 << BITS) - 1}, k + 1) as int)) as preimage, cast(shiftright(p, k) & 1 as int) as slot)), x -> x.preimage is not null)"
    return nodes.select(*kept).join(above, (F.col("g") == F.col("_g")) & (F.shiftright("p", BITS) == F.col("_p"))).select(*kept, F.concat(F.expr(own), F.col("_path")).alias("path"), "top")


def paths(nodes: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """nodes (g, p, ...) with ``path`` from the lowest ancestor to the group's own digest ``top``."""
    none = F.expr("cast(array() as array<struct<preimage: string, slot: int>>)")
    above = blocks[-1].withColumn("path", none)
    for tier in reversed(blocks[:-1]):
        above = _joined(tier, above)
    return _joined(nodes, above)


def siblings(path: Column) -> Column:
    """What a proof holds: the siblings' digests, level by level."""
    cut = lambda x: F.concat(F.substr(x.preimage, F.lit(1), WIDTH * x.slot), F.substr(x.preimage, WIDTH * x.slot + WIDTH + 1))
    return F.array_join(F.transform(path, cut), "")


def folded(path: Column, start: Column) -> Column:
    """The root that ``start`` leads to in the place of the path's leaf."""
    splice = lambda h, x: F.sha2(F.concat(F.substr(x.preimage, F.lit(1), WIDTH * x.slot), h, F.substr(x.preimage, WIDTH * x.slot + WIDTH + 1)), 256)
    return F.aggregate(path, start, splice)


def proofs(rows: DataFrame, leaf_col: str, group: str, order: str) -> DataFrame:
    """rows with ``subroot``, ``path`` (ancestors' preimages and slots, lowest first) and ``root``.

    Reads its input once; the columns of rows are kept.
    """
    names = rows.columns
    held = save(rows.select("*", F.monotonically_increasing_id().alias("_row")), "leaves")
    placed = ranked(held, F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first(), leaf_col, "_row", name="_rank")
    groups = save(ranked(placed.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n"), F.min("_rank").alias("_first")), F.col("_group").asc_nulls_first(), name="_g"), "groups")
    n_groups, most = groups.agg(F.count("*"), F.max("n")).first()
    nodes = placed.join(groups, F.col(group).eqNullSafe(F.col("_group"))).withColumns({"g": F.col("_g") - 1, "p": F.col("_rank") - F.col("_first"), "h": F.col(leaf_col)}).drop("_group", "_rank", "_first", "_row", "_g")
    nodes = save(nodes, "nodes")
    low = tiers(nodes.select("g", "n", "p", "h"), most or 0)
    heads = low[-1].select(F.lit(0).cast("long").alias("g"), F.lit(n_groups).cast("long").alias("n"), F.col("g").alias("p"), F.col("top").alias("h"))
    high = paths(heads, tiers(heads, n_groups)).select(F.col("p").alias("_of"), F.col("h").alias("subroot"), F.col("path").alias("_up"), F.col("top").alias("root"))
    return paths(nodes, low).join(high, F.col("g") == F.col("_of")).select(*names, "subroot", F.concat("path", "_up").alias("path"), "root")


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the leaf of each row, and where the report tampers with it the leaf of the changed row."""
    fields = [F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in FIELDS]
    doc_id, _, lang, n_chars, _ = fields
    more = [(n_chars.cast("decimal(20,0)") + 1).cast("decimal(20,0)") if c == "n_chars" else f for c, f in zip(FIELDS, fields)]
    chosen = (F.crc32(doc_id.cast("string").cast("binary")) % TAMPER == 0) & n_chars.isNotNull()
    return docs.select(doc_id.alias("doc_id"), lang.cast("string").alias("lang"), leaf(fields).alias("leaf"), F.when(chosen, leaf(more)).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """(lang, subroot, root), one row a lang."""
    return proofs(leaves(docs), "leaf", "lang", "doc_id").select("lang", "subroot", "root").distinct()


def report(docs: DataFrame) -> DataFrame:
    """Each row's leaf and proof, and whether it still verifies after the report's tampering."""
    done = proofs(leaves(docs), "leaf", "lang", "doc_id")
    out = done.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("path"), F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda c, x: xor(c >> 8, list_reduce(list_prepend(xor(c & 255, x), range(8)), lambda t, _: CASE WHEN t & 1 = 1 THEN xor(3988292384::BIGINT, t >> 1) ELSE t >> 1 END)))"
_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f"CAST({n_chars if c == 'n_chars' else c} AS VARCHAR)") for c in FIELDS) + ")"


#: Levels of both trees by recursion, then each row's way up; crc32 bit by bit.
ORACLE = f"""
WITH RECURSIVE told AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN n_chars IS NOT NULL AND xor({_CRC}, 4294967295::BIGINT) % {TAMPER} = 0 THEN {_leaf('(n_chars + 1)')} END AS tampered FROM documents),
placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM told),
low AS (SELECT g, 0 AS level, p, n, leaf AS h FROM placed
  UNION ALL SELECT g, level + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM low WHERE n > 1 GROUP BY g, level, p // 2, (n + 1) // 2),
tops AS (SELECT g, h FROM low WHERE n = 1),
high AS (SELECT 0 AS level, g AS p, (SELECT count(*) FROM tops) AS n, h FROM tops
  UNION ALL SELECT level + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM high WHERE n > 1 GROUP BY level, p // 2, (n + 1) // 2),
up AS (SELECT doc_id, leaf, g, p AS own, 0 AS level, p, n, coalesce(tampered, leaf) AS h, '' AS proof FROM placed
  UNION ALL SELECT u.doc_id, u.leaf, u.g, u.own, u.level + 1, u.p // 2, (u.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN u.h WHEN s.p < u.p THEN s.h || u.h ELSE u.h || s.h END), u.proof || coalesce(s.h, '')
  FROM up u LEFT JOIN low s ON s.g = u.g AND s.level = u.level AND s.p = xor(u.p, 1::BIGINT) WHERE u.n > 1),
further AS (SELECT doc_id, leaf, g, own, 0 AS level, g AS p, (SELECT count(*) FROM tops) AS n, h, proof FROM up WHERE n = 1
  UNION ALL SELECT u.doc_id, u.leaf, u.g, u.own, u.level + 1, u.p // 2, (u.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN u.h WHEN s.p < u.p THEN s.h || u.h ELSE u.h || s.h END), u.proof || coalesce(s.h, '')
  FROM further u LEFT JOIN high s ON s.level = u.level AND s.p = xor(u.p, 1::BIGINT) WHERE u.n > 1)
SELECT f.doc_id, f.leaf, t.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM further f JOIN tops t USING (g), (SELECT h FROM high WHERE n = 1) r WHERE f.n = 1
"""
