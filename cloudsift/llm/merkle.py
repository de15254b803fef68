"""A Merkle manifest of a dataset, with every row's proof, by butterfly exchange.

Rows are leaves of one tree per group, in key order, and the groups' roots are leaves of a tree above. Places
come from one range sort over all rows: a row's place is its number in its partition plus what earlier
partitions hold of its group, so a group of any size is spread over many tasks.

Aligned blocks of `fanout ** BLOCK_LEVELS` leaves are hashed each by itself. Above them, blocks play the
partitions of a butterfly: in round r, the `fanout` blocks whose numbers differ in digit r alone meet, swap the roots that
they hold, and each hashes their ancestor for itself. What it got from the others is its proof at that
level, so after the last round every block holds the group's root and its whole upper proof, and nothing is
sent back down. Numbers are padded to a power of the fanout; a block without leaves holds no root at first
and takes part like others, so that every block meets its partners although the last run is short.

Everything is SQL functions; a task has at most a block, and a round shuffles a row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.llm.store import Store

FANOUT, BLOCK_LEVELS = 2, 10
#: A proof names, level by level, what stands left and right of the node within its run.
PROOF = "array<struct<before:string,after:string>>"
#: Bits that number a row within its partition.
IN_PARTITION = 33


def encoded(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def joined(hashes: Column) -> Column:
    """The digest of a run's hashes; nulls stand for no node."""
    return F.sha2(F.array_join(hashes, "").cast("binary"), 256)


def levels_over(n: Column, fanout: int) -> Column:
    """How often n nodes are to be hashed in runs until one remains."""
    powers = [fanout**k for k in range(63) if fanout**k < 1 << 62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < n))


def numbered(store: Store, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, which have `g`, with `place` in their g (in the order of the columns, nulls first) and `total` of it; written.

    The last column of the order must tell all rows of a g apart.
    """
    by = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    ordered = store.put(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", IN_PARTITION)), f"{name}_ordered")
    counts = ordered.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    runs = counts.selectExpr("g as g_", "part as part_", "first - coalesce(sum(n) over (partition by g order by part rows between unbounded preceding and 1 preceding), 0) as base", "sum(n) over (partition by g) as total")
    met = ordered.join(runs, (F.col("g") == F.col("g_")) & (F.col("part") == F.col("part_")))
    out = store.put(met.select(*rows.columns, (F.col("id") - F.col("base")).alias("place"), "total"), f"{name}_numbered")
    store.drop(f"{name}_ordered")
    return out


def block_levels(members: Column, depth: Column, fanout: int) -> Column:
    """All levels of a block, leaves first: an array of arrays of hashes; `members` is sorted."""
    above = lambda level: F.transform(F.sequence(F.lit(0), ((F.size(level) - 1) / fanout).cast("int")), lambda i: joined(F.slice(level, i * fanout + 1, fanout)))
    leaves = F.array(F.transform(members, lambda m: m["hash"]))
    return F.when(depth == 0, leaves).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), leaves, lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1))))))


def siblings(level: Column, at: Column, fanout: int) -> Column:
    """Of a node at a place of a level: the hashes left and right of it within its run."""
    first = (at - at % fanout).cast("int")
    return F.struct(
        F.array_join(F.slice(level, first + 1, (at % fanout).cast("int")), "").alias("before"),
        F.array_join(F.slice(level, (at + 2).cast("int"), (fanout - 1 - at % fanout).cast("int")), "").alias("after"),
    )


def blocks_of(rows: DataFrame, fanout: int, columns: list[str]) -> DataFrame:
    """A row per block: g, block, total, members (sorted by place) and levels."""
    size = fanout**BLOCK_LEVELS
    block = rows.withColumn("block", F.floor(F.col("place") / size)).groupBy("g", "block", "total")
    members = block.agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias("members"))
    depth = F.least(F.lit(BLOCK_LEVELS), levels_over(F.col("total"), fanout))
    return members.withColumn("levels", block_levels(F.col("members"), depth, fanout))


def butterfly(store: Store, blocks: DataFrame, fanout: int, name: str) -> DataFrame:
    """A row per block of `blocks` (g, block, total, root): g, block, the root of its g, and the block's upper proof."""
    size = fanout**BLOCK_LEVELS
    n_blocks = F.ceil(F.col("total") / size)
    state = blocks.withColumn("rounds", levels_over(n_blocks, fanout)).withColumn("proof", F.array().cast(PROOF))
    # Blocks without leaves, up to a power of the fanout; the last block of a g makes them.
    padded = F.element_at(F.array(*[F.lit(fanout**k) for k in range(63) if fanout**k < 1 << 62]), F.col("rounds") + 1)
    empty = state.filter((F.col("block") == n_blocks - 1) & (padded > n_blocks)).withColumn("block", F.explode(F.sequence(n_blocks, padded - 1))).withColumn("root", F.lit(None).cast("string"))
    state = store.put(state.unionByName(empty), f"{name}_round0")
    finished, most = [state.filter("rounds = 0")], state.agg(F.max("rounds")).first()[0] or 0
    for r in range(most):
        below, span = fanout**r, fanout ** (r + 1)
        number = F.col("block")
        partners = state.filter(F.col("rounds") > r).groupBy("g", "rounds", "total", (F.floor(number / span) * below + number % below).alias("meet"))
        met = partners.agg(F.sort_array(F.collect_list(F.struct("block", "root", "proof"))).alias("members"))
        roots = F.transform("members", lambda m: m["root"])
        parent = F.when(F.exists(roots, lambda h: h.isNotNull()), joined(roots))
        each = met.withColumn("parent", parent).select("g", "rounds", "total", "parent", "members", F.posexplode("members").alias("digit", "own"))
        state = store.put(
            each.select("g", F.col("own.block").alias("block"), "total", F.col("parent").alias("root"), "rounds", F.concat(F.col("own.proof"), F.array(siblings(F.transform("members", lambda m: m["root"]), F.col("digit"), fanout))).alias("proof")),
            f"{name}_round{r + 1}",
        )
        finished.append(state.filter(F.col("rounds") == r + 1))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.filter(F.col("block") < n_blocks).select("g", "block", "root", "proof")


def trees(store: Store, rows: DataFrame, order: list[str], fanout: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(leaves with places and totals; a row per block with the root of its g and its upper proof) of one tree per g over `hash`."""
    leaves = numbered(store, rows, order, name)
    roots = blocks_of(leaves, fanout, ["hash"]).select("g", "block", "total", F.element_at(F.element_at("levels", -1), 1).alias("root"))
    return leaves, butterfly(store, roots, fanout, name)


def with_proofs(leaves: DataFrame, upper: DataFrame, fanout: int, columns: list[str]) -> DataFrame:
    """The leaves' columns, the root of their g and their whole proof up to it; `upper` may have more columns, which stay."""
    blocks = blocks_of(leaves, fanout, ["hash", *columns]).drop("total")
    above = upper.withColumnsRenamed({"g": "g_", "block": "block_", "proof": "upper"})
    met = blocks.join(above, (F.col("g") == F.col("g_")) & (F.col("block") == F.col("block_"))).drop("g_", "block_", "block")
    # A member gets its proof before blocks are taken apart, so that no row carries a whole block.
    own = lambda at: F.transform(F.slice("levels", 1, F.size("levels") - 1), lambda level, k: siblings(level, F.floor(at / F.pow(F.lit(fanout), k)).cast("int"), fanout))
    members = F.transform("members", lambda m, at: F.struct(*(m[c].alias(c) for c in ("hash", *columns)), own(at).alias("lower")))
    each = met.select(*(c for c in met.columns if c not in {"members", "levels"}), F.explode(members).alias("own"))
    return each.select(*(c for c in each.columns if c not in {"upper", "own"}), *(f"own.{c}" for c in ("hash", *columns)), F.concat("own.lower", "upper").alias("proof"))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf gives with a proof."""
    return F.aggregate(proof, start, lambda node, run: F.sha2(F.concat(run["before"], node, run["after"]).cast("binary"), 256))


def digest(proof: Column) -> Column:
    """The digest of a proof's hashes, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["before"], run["after"])), "").cast("binary"), 256)


def manifest(spark: SparkSession, rows: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", fanout: int = FANOUT, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row: key, leaf, subroot, root, proof and checked (the leaf, or where `where` holds that of the row with `changed` columns).

    A leaf is the digest of `columns`. Rows with a null group have a tree of their own, which comes first; keys
    may be null (first of their group) or repeat (then ordered by leaf; equal rows take places next to
    each other). A group of one row has its leaf as root and an empty proof up to it. Null where is false. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    store = Store(spark, "merkle")
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    other = [(changed or {}).get(c, F.col(c)) for c in columns]
    leaves = rows.select(
        g.alias("g"), F.col(key).cast("long").alias("key"), leaf([F.col(c) for c in columns]).alias("hash"),
        F.when(F.lit(False) if where is None else where, leaf(other)).alias("bent"), F.monotonically_increasing_id().alias("row"),
    )
    leaves, upper = trees(store, store.put(leaves, "leaves"), ["key", "hash", "row"], fanout, "group")
    upper = store.put(upper, "upper")
    groups = upper.filter("block = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("hash"))
    tops, over = trees(store, groups, ["name"], fanout, "top")
    top = store.put(with_proofs(tops, over, fanout, ["name"]).select(F.col("name").alias("name_"), F.col("root").alias("top"), F.col("proof").alias("top_proof")), "over")
    met = upper.join(top, F.col("g") == F.col("name_")).drop("name_")
    out = with_proofs(leaves, met, fanout, ["key", "bent"])
    return out.select(
        F.col("key").alias(key), F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"),
        F.concat("proof", "top_proof").alias("proof"), F.coalesce("bent", "hash").alias("checked"),
    )


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Rows whose crc32 this divides are tampered with.
TAMPERED = 7


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its row, changed in every seventh or so, still proves the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = manifest(spark, docs, COLUMNS, changed={"n_chars": F.col("n_chars") + 1}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0)
    fold = folded(F.col("checked"), F.col("proof"))
    return out.select("doc_id", "leaf", "subroot", "root", digest(F.col("proof")).alias("proof_sha256"), fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = """
WITH RECURSIVE
bytes AS (SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS code FROM range(256) t(i)),
codes AS (SELECT list(code::BIGINT ORDER BY i) AS code FROM bytes),
crc AS (
  SELECT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                                 lambda a, b: xor(a >> 8, code[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 AS bent
  FROM documents, codes),
enc AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS m, coalesce(strlen(text) || ':' || text, '-') AS t
  FROM documents),
leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(a || n || t) AS leaf, sha256(a || CASE WHEN bent THEN m ELSE n END || t) AS checked,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p
  FROM enc JOIN crc USING (doc_id)),
node AS (
  SELECT 0 AS lvl, g, p, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaf
  UNION ALL
  SELECT lvl + 1, g, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM node WHERE n > 1 GROUP BY lvl, g, p // 2, n),
top AS (
  SELECT 0 AS lvl, g, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS n FROM node WHERE n = 1
  UNION ALL
  SELECT lvl + 1, min(g), p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, p // 2, n),
place AS (SELECT g, p, h AS subroot FROM top WHERE lvl = 0),
lower AS (SELECT l.doc_id, string_agg(s.h, '' ORDER BY s.lvl) AS proof FROM leaf l JOIN node s ON s.g = l.g AND s.p = xor(l.p >> s.lvl, 1) GROUP BY l.doc_id),
upper AS (SELECT l.g, string_agg(s.h, '' ORDER BY s.lvl) AS proof FROM place l JOIN top s ON s.p = xor(l.p >> s.lvl, 1) GROUP BY l.g),
climb AS (
  SELECT doc_id, g, 0 AS lvl, p, checked AS h FROM leaf
  UNION ALL
  SELECT c.doc_id, c.g, c.lvl + 1, c.p // 2, sha256(CASE WHEN c.p % 2 = 0 THEN c.h || coalesce(s.h, '') ELSE s.h || c.h END)
  FROM climb c JOIN (SELECT DISTINCT g, lvl FROM node WHERE n > 1) z ON z.g = c.g AND z.lvl = c.lvl LEFT JOIN node s ON s.g = c.g AND s.lvl = c.lvl AND s.p = xor(c.p, 1)),
high AS (
  SELECT doc_id, 0 AS lvl, place.p, h FROM (SELECT doc_id, g, arg_max(h, lvl) AS h FROM climb GROUP BY doc_id, g) JOIN place USING (g)
  UNION ALL
  SELECT c.doc_id, c.lvl + 1, c.p // 2, sha256(CASE WHEN c.p % 2 = 0 THEN c.h || coalesce(s.h, '') ELSE s.h || c.h END)
  FROM high c JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) z ON z.lvl = c.lvl LEFT JOIN top s ON s.lvl = c.lvl AND s.p = xor(c.p, 1)),
ends AS (SELECT doc_id, arg_max(h, lvl) AS folded_root FROM high GROUP BY doc_id),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(lower.proof, '') || coalesce(upper.proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN place USING (g) JOIN ends USING (doc_id) LEFT JOIN lower USING (doc_id) LEFT JOIN upper ON upper.g = leaf.g, root
"""
