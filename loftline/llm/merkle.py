"""A dataset manifest: a Merkle tree over the documents of each language, proofs, and the root recomputed from them.

Leaves of a language ascend by doc_id, and FANOUT neighbours become their hash.  A block is an aligned run of
FANOUT^LEVELS leaves, and one row: its part of the tree is hashed in one task.  Above the blocks there is a butterfly exchange:
in a round, blocks of the up to FANOUT neighbouring subtrees that share a parent swap those subtrees' roots, each block
with one block of each other subtree, and all of them hash the parent.  So after the last round every block has the
root, and all siblings from its own subtree up to it: proofs need no pass downward.  A block sends at most as many rows as it
gets: FANOUT in a round.  Rounds go on over languages as over blocks: a subtree is just a range of numbered blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

FANOUT = 8
#: Levels of a block: it has FANOUT^LEVELS leaves.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields: `-` for null, else the UTF-8 length, a colon and the value."""
    shown = [F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in fields]
    return F.sha2(F.concat(*(F.coalesce(s, F.lit("-")) for s in shown)), 256)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by lang: adds the task, the number of the lang in the task, and the row's place in it."""
    task, run, last, place = TaskContext.get().partitionId(), -1, None, 0
    for b in batches:
        lang = b["lang"].to_pylist()
        runs, places = np.zeros(len(lang), np.int64), np.zeros(len(lang), np.int64)
        for i, x in enumerate(lang):
            if run < 0 or x != last:
                run, last, place = run + 1, x, 0
            runs[i], places[i] = run, place
            place += 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lang), task, np.int64)), pa.array(runs), pa.array(places)], [*b.schema.names, "task", "run", "place"])


def raised(nodes: list[str], levels: int | None, fanout: int = FANOUT) -> list[list[str]]:
    """All levels over nodes: as many as given, or up to the one with a single node."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def _hexes(data: bytes) -> list[str]:
    text = data.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _tops(batches: Iterator[pa.RecordBatch], levels: int, fanout: int) -> Iterator[pa.RecordBatch]:
    """The root of each block: a lone block of its language ends where one node is left."""
    for b in batches:
        tops = [raised(_hexes(leaves.as_py()), None if blocks == 1 else levels, fanout)[-1][0] for leaves, blocks in zip(b["leaves"], b["blocks"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["q"], pa.array(tops)], ["q", "node"])


def _proofs(batches: Iterator[pa.RecordBatch], levels: int, fanout: int) -> Iterator[pa.RecordBatch]:
    """Blocks with their siblings above: one row for each leaf."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    for b in batches:
        for row in b.to_pylist():
            leaves, changed = _hexes(row["leaves"]), _hexes(row["changed"])
            tree = raised(leaves, None if row["blocks"] == 1 else levels, fanout)
            above = [(s["place"], s["run"]) for s in row["proof"]]
            upper = "".join(x for place, run in above for k, x in enumerate(run) if k != place)
            out = []
            for i, (own, new) in enumerate(zip(leaves, changed, strict=True)):
                proof, node, at = [], new, i
                for nodes in tree[:-1]:
                    lo = at - at % fanout
                    run = nodes[lo : lo + fanout]
                    place = at - lo
                    proof += run[:place] + run[place + 1 :]
                    node = digest(*run[:place], node, *run[place + 1 :])
                    at //= fanout
                for place, run in above:
                    node = digest(*run[:place], node, *run[place + 1 :])
                out.append((own, row["subroot"], row["root"], digest(*proof, upper), node))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), *(pa.array(list(c), pa.string()) for c in zip(*out, strict=True))], names)


def _exchange(state: DataFrame, children: Column, place: Column) -> DataFrame:
    """One round.  state (q, node, proof, ...): children are the ranges (s, e) of blocks of the sibling subtrees, of which
    place is the own one.  A block sends its node to every so-maniest block of each sibling, and its own row to itself."""
    q, own = F.col("q"), F.element_at(children, place + 1)
    step, at = own["e"] - own["s"], q - own["s"]
    to = lambda c, i: F.when(i == place, F.array(q)).when(c["s"] + at < c["e"], F.sequence(c["s"] + at, c["e"] - 1, step)).otherwise(F.array().cast("array<long>"))
    kept = F.struct(*(c for c in state.columns if c not in ("q", "node")))
    sent = state.select("q", "node", place.alias("place"), kept.alias("kept"), F.explode(F.flatten(F.transform(children, to))).alias("to"))
    sent = sent.select("to", "place", "node", F.when(F.col("q") == F.col("to"), F.struct("place", "kept")).alias("mine"))
    got = sent.groupBy("to").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("run"), F.first("mine", ignorenulls=True).alias("mine"))
    run = F.transform("run", lambda x: x["node"])
    seen = F.struct(F.col("mine.place").alias("place"), run.alias("run"))
    rest = [F.array_append("mine.kept.proof", seen).alias("proof") if c == "proof" else F.col(f"mine.kept.{c}").alias(c) for c in state.columns if c not in ("q", "node")]
    return got.select(F.col("to").alias("q"), F.sha2(F.array_join(run, ""), 256).alias("node"), *rest)


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs needs doc_id, source, lang, n_chars and text; other columns are ignored.  Nulls have their own mark in a leaf.
    A null lang is a language of its own, the first; an empty one comes next.  A null doc_id comes first in its
    language and isn't tampered with; rows of one doc_id are in order of their leaves, and equal rows are neighbours, so their
    proofs differ although their leaves don't.  An empty table gives no row.
    """
    spark = docs.sparkSession
    own = [F.col(c) for c in FIELDS]
    tampered = leaf([*own[:-1], F.translate(F.col("text").cast("string"), UPPER, LOWER)])
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf(own).alias("leaf"), F.when(hit, tampered).alias("changed"))
    rows = rows.select("doc_id", "lang", F.unhex("leaf").alias("leaf"), F.unhex(F.coalesce("changed", "leaf")).alias("changed"), F.monotonically_increasing_id().alias("tie"))
    rows = staged(rows, "leaves")
    # Places by language: of a task's rows first, then what the tasks before it have.  A range may hold any share of a language.
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("tie")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = staged(ordered.mapInArrow(_numbered, "doc_id long, lang string, leaf binary, changed binary, tie long, task long, run long, place long"), "ordered")
    runs = ordered.groupBy("task", "run").agg(F.first("lang").alias("lang"), F.count("*").alias("n"))
    # As many rows as there are tasks and languages together; then a row for each language.
    first = Window.partitionBy("lang").orderBy("task", "run")
    runs = staged(runs.withColumn("before", F.sum("n").over(first) - F.col("n")), "runs")
    size = fanout**levels
    langs = runs.groupBy("lang").agg(F.ceil(F.sum("n") / size).alias("blocks"))
    by_lang = Window.orderBy(F.asc_nulls_first("lang"))
    langs = staged(langs.withColumns({"language": F.row_number().over(by_lang) - 1, "first": F.sum("blocks").over(by_lang) - F.col("blocks")}), "langs")
    limits = langs.agg(F.count("*").alias("langs"), F.max("blocks").alias("blocks")).first()
    runs = runs.join(langs, runs["lang"].eqNullSafe(langs["lang"])).select("task", "run", "before", "blocks", "language", "first")
    rank = F.col("place") + F.col("before")
    placed = ordered.join(runs, ["task", "run"]).withColumns({"at": F.pmod(rank, F.lit(size)), "q": F.col("first") + F.floor(rank / size)})
    # A block is bounded: `size` leaves.
    held = F.sort_array(F.collect_list(F.struct("at", "doc_id", "leaf", "changed")))
    blocks = placed.groupBy("q").agg(held.alias("held"), F.first("blocks").alias("blocks"), F.first("language").cast("long").alias("language"), F.first("first").alias("first"))
    joined = lambda c: F.array_join(F.transform("held", lambda x: F.hex(x[c])), "")
    blocks = blocks.select("q", "blocks", "language", "first", F.col("held.doc_id").alias("doc_ids"), F.unhex(joined("leaf")).alias("leaves"), F.unhex(joined("changed")).alias("changed"))
    blocks = staged(blocks, "blocks")
    tops = blocks.select("q", "leaves", "blocks").mapInArrow(partial(_tops, levels=levels, fanout=fanout), "q long, node string")
    none = F.array().cast("array<struct<place:int,run:array<string>>>")
    state = tops.join(blocks.select("q", "blocks", "language", "first"), "q").withColumn("proof", none)
    reach = 1  # blocks of a full subtree
    while reach < (limits["blocks"] or 0):
        end, here = F.col("first") + F.col("blocks"), F.floor((F.col("q") - F.col("first")) / reach)
        low = F.col("first") + F.floor(here / fanout) * fanout * reach
        starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda i: low + i * reach), lambda s: s < end)
        ranges = F.transform(starts, lambda s: F.struct(s.alias("s"), F.least(s + reach, end).alias("e")))
        # A language whose tree is done takes no part.
        state = _exchange(state.where(F.col("blocks") > reach), ranges, F.pmod(here, F.lit(fanout)).cast("int")).unionByName(state.where(F.col("blocks") <= reach))
        state = staged(state, "round")
        reach *= fanout
    state = state.withColumn("subroot", F.col("node"))
    reach = 1  # languages of a full subtree
    while reach < (limits["langs"] or 0):
        here = lambda d, r=reach: F.floor(d / r)
        nodes = langs.groupBy(here(F.col("language")).alias("node")).agg(F.min("first").alias("s"), F.max(F.col("first") + F.col("blocks")).alias("e"))
        ranges = nodes.groupBy(F.floor(F.col("node") / fanout).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("ranges"))
        joined_state = state.withColumn("parent", F.floor(here(F.col("language")) / fanout)).join(ranges, "parent")
        place = F.pmod(here(F.col("language")), F.lit(fanout)).cast("int")
        state = staged(_exchange(joined_state, F.col("ranges"), place).drop("parent", "ranges"), "round")
        reach *= fanout
    state = state.select("q", F.col("node").alias("root"), "subroot", "proof")
    done = blocks.join(state, "q").select("blocks", "doc_ids", "leaves", "changed", "root", "subroot", "proof")
    found = done.mapInArrow(partial(_proofs, levels=levels, fanout=fanout), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE c AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
     f AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                  || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
             CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS new FROM c),
     g AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(new) || ':' || new, '-')) AS changed FROM f),
     d AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS l, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM g),
     lower_nodes AS (SELECT 0 AS step, l, p, leaf AS node, n FROM d
                     UNION ALL SELECT step + 1, l, p // 8, sha256(string_agg(node, '' ORDER BY p)), (n + 7) // 8 FROM lower_nodes WHERE n > 1 GROUP BY step, l, p // 8, n),
     subroots AS (SELECT l, step AS height, node FROM lower_nodes WHERE n = 1),
     upper_nodes AS (SELECT 0 AS step, l AS p, node, (SELECT count(*) FROM subroots) AS n FROM subroots
                     UNION ALL SELECT step + 1, p // 8, sha256(string_agg(node, '' ORDER BY p)), (n + 7) // 8 FROM upper_nodes WHERE n > 1 GROUP BY step, p // 8, n),
     nodes AS (SELECT l, step, p, node FROM lower_nodes WHERE n > 1 UNION ALL SELECT s.l, s.height + u.step, u.p, u.node FROM upper_nodes u, subroots s WHERE u.n > 1),
     walk AS (SELECT d.l, d.p AS i, s.height, 0 AS step, CASE WHEN s.height = 0 THEN d.l ELSE d.p END AS p, d.changed AS node FROM d JOIN subroots s ON s.l = d.l
              UNION ALL SELECT w.l, w.i, w.height, w.step + 1, CASE WHEN w.step + 1 = w.height THEN w.l ELSE w.p // 8 END, sha256(string_agg(CASE WHEN x.p = w.p THEN w.node ELSE x.node END, '' ORDER BY x.p))
              FROM walk w JOIN nodes x ON x.l = w.l AND x.step = w.step AND x.p // 8 = w.p // 8 GROUP BY w.l, w.i, w.height, w.step, w.p, w.node),
     folded AS (SELECT l, i, arg_max(node, step) AS folded_root FROM walk GROUP BY l, i),
     proofs AS (SELECT w.l, w.i, string_agg(x.node, '' ORDER BY w.step, x.p) AS proof FROM walk w JOIN nodes x ON x.l = w.l AND x.step = w.step AND x.p // 8 = w.p // 8 AND x.p <> w.p GROUP BY w.l, w.i)
SELECT d.doc_id, d.leaf, s.node AS subroot, r.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM d JOIN subroots s ON s.l = d.l JOIN folded f ON f.l = d.l AND f.i = d.p LEFT JOIN proofs q ON q.l = d.l AND q.i = d.p, (SELECT node FROM upper_nodes WHERE n = 1) r
"""
