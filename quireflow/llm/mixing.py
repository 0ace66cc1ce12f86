"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

Each source is a stream of words: its documents in hashed order, repeated as often as its target asks. The stream is
cut into blocks of block_words; the mix has an exact quota of blocks of each source. A tree halves the range of output
shards again and again, and draws for each node how many blocks of each source go left, which is multivariate
hypergeometric; so each shard has a quota of its own. A keyed bijection permutes the numbers of a source's blocks; shards take
disjoint runs of the permuted blocks, so that each draws from all passes through a source, and order their blocks by hash.

Defined results: null text has size 0; a null source is a source of its own, the last; documents of size 0 are never
taken; an empty table, or one without words, gives targets of 0; repeated rows are documents of their own. Rows are
told apart by their place in the source's stream, so doc_id may be null or repeated. Ties in the hashed order are broken
by doc_id and size; very long texts are counted whole and cut into blocks. The number of sources must fit in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import free_name, stored

WEIGHTS, CAP = (5, 2, 1), 3
#: Words in a block, blocks in a shard, documents at most (about) in a bucket of the hashed order.
BLOCK_WORDS, SHARD_BLOCKS, BUCKET_DOCS = 1024, 4096, 20_000
#: Nodes of the tree above which they are dealt out, and tasks that they are dealt to at least.
SPREAD = 64
WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with number, weight, target and quota (whole words).

    The sizes' sum is shared by weight; a target stops at CAP times its source's size, the excess goes to the others by weight.
    In the order of size / weight, a source is stopped if at the level that the sources from it on would have, it is above.
    """
    by_code_point, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    order = Window.orderBy("ratio", "number")
    s = sources.withColumn("number", F.row_number().over(by_code_point) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", CAP * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open")).withColumn("full", F.col("ratio") <= F.col("level"))
    s = s.withColumn("rest", F.min(F.when(~F.col("full"), F.struct("ratio", "number", "level"))).over(every)["level"])
    s = s.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("rest") * F.col("weight")))
    return s.select("source", "number", "weight", "source_size", "target", F.least(F.round("target").cast("long"), "limit").alias("quota"))


def _lf(n: str) -> str:
    """log n!"""
    x = f"cast({n} AS double)"
    return f"(CASE WHEN {n} < 2 THEN 0D WHEN {n} <= 20 THEN ln(factorial(cast({n} AS int))) ELSE ({x} + 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}) END)"


def _left(seed: int) -> str:
    """SQL for the blocks of each source, of those in the array q, that go to the left half [lo, mid) of [lo, hi): cap draws.

    Source after source: of n draws left from N blocks left of which K are the source's, the number that are has the
    hypergeometric distribution; the draw inverts it, over ten standard deviations about the mean, at a hashed number.
    """
    of, draws, own = "a.blocks", "a.draws", "element_at(q, i)"
    terms = [(1, own), (-1, "v"), (-1, f"({own} - v)"), (1, f"({of} - {own})"), (-1, f"({draws} - v)"), (-1, f"({of} - {own} - {draws} + v)"), (-1, of), (1, draws), (1, f"({of} - {draws})")]
    pmf = "exp(" + " ".join(f"{'+' if sign > 0 else '-'} {_lf(n)}" for sign, n in terms) + ")"
    mean = f"({draws} * ({own} / {of}))"
    sd = f"sqrt(greatest(0D, {mean} * (1 - {own} / {of}) * (({of} - {draws}) / greatest({of} - 1, 1))))"
    least, most = f"greatest(0L, {draws} - ({of} - {own}))", f"least({draws}, {own})"
    low, high = f"greatest({least}, cast(floor({mean} - 10 * {sd}) AS bigint) - 3L)", f"least({most}, cast(ceil({mean} + 10 * {sd}) AS bigint) + 3L)"
    u = f"(pmod(xxhash64({seed}L, lo, hi, i), 9007199254740992L) / 9007199254740992D)"
    step = f"transform(array({pmf}), p -> named_struct('c', s.c + p, 'x', CASE WHEN s.c + p < {u} THEN least(v + 1L, {high}) ELSE s.x END))[0]"
    x = f"CASE WHEN {of} <= 0 OR {draws} <= 0 OR {own} <= 0 THEN 0L ELSE aggregate(sequence({low}, {high}), named_struct('c', 0D, 'x', {low}), (s, v) -> {step}, s -> s.x) END"
    one = f"transform(array({x}), x -> named_struct('blocks', {of} - {own}, 'draws', {draws} - x, 'out', concat(a.out, array(x))))[0]"
    return f"aggregate(sequence(1, size(q)), named_struct('blocks', aggregate(q, 0L, (s, v) -> s + v), 'draws', draws, 'out', cast(array() AS array<bigint>)), (a, i) -> {one}, a -> a.out)"


def permuted(place: str, n: str, key: str) -> str:
    """SQL for a bijection of [0, n) keyed by key, at place: rounds that shift the rows and columns of a grid of about n cells by hashes of each other.

    The grid has less than a row too many. A place outside [0, n) goes on until it is back in, which it is after as many
    steps as there are places outside, fewer than the root of n: 64 steps, each of which fails with the odds of one to that root.
    """
    wide = f"greatest(1L, cast(ceil(sqrt(cast({n} AS double))) AS bigint))"
    half = lambda x, y, size: f"pmod(s.{x} + pmod(xxhash64({key}, r, s.{y}), {size}), {size})"
    turn = f"CASE WHEN r % 2 = 1 THEN named_struct('x', {half('x', 'y', 'g.a')}, 'y', s.y) ELSE named_struct('x', s.x, 'y', {half('y', 'x', 'g.b')}) END"
    once = f"aggregate(sequence(1, 8), named_struct('x', v div g.b, 'y', pmod(v, g.b)), (s, r) -> {turn}, s -> s.x * g.b + s.y)"
    grid = f"transform(array({wide}), a -> named_struct('a', a, 'b', greatest(1L, cast(({n} + a - 1) div a AS bigint))))"
    return f"transform({grid}, g -> aggregate(sequence(1, 64), {place}, (v, i) -> CASE WHEN i > 1 AND v < {n} THEN v ELSE {once} END))[0]"


def shard_quotas(sources: DataFrame, block_words: int, shard_blocks: int, seed: int) -> tuple[DataFrame, int]:
    """(shard, number, blocks, first, total): each shard's blocks of each source are those at the places [first, first + blocks) of total; and the number of shards.

    The upper levels of the tree are one task's work; below SPREAD nodes, the subtrees are dealt out.
    """
    blocks = F.expr(f"(quota + {block_words - 1}) div {block_words}")
    root = sources.select("number", blocks.alias("blocks")).agg(F.expr("transform(array_sort(collect_list(struct(number, blocks))), x -> x.blocks)").alias("q"))
    total = sources.agg(F.coalesce(F.sum(blocks), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_blocks))
    cap = lambda k: f"cast(floor({total}D * ({k}) / {shards}) AS bigint)"  # noqa: E731  blocks before shard k
    nodes = root.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "q")
    tasks = max(SPREAD, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for level in range((shards - 1).bit_length()):
        if level == SPREAD.bit_length():
            nodes = nodes.repartition(tasks, "lo")
        nodes = nodes.withColumn("mid", F.expr("(lo + hi) div 2")).withColumn("draws", F.expr(f"{cap('mid')} - {cap('lo')}"))
        nodes = nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.expr(_left(seed))))
        right = "transform(q, (k, i) -> k - left[i])"
        halves = f"CASE WHEN hi - lo > 1 THEN array(named_struct('lo', lo, 'hi', mid, 'q', left), named_struct('lo', mid, 'hi', hi, 'q', {right})) ELSE array(named_struct('lo', lo, 'hi', hi, 'q', q)) END"
        nodes = nodes.select(F.explode(F.expr(halves)).alias("x")).select("x.*")
    leaves = nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("number", "blocks"))
    before, whole = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("number")
    return leaves.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))).withColumn("total", F.sum("blocks").over(whole)), shards


def placed(docs: DataFrame, seed: int = 42, bucket_docs: int = BUCKET_DOCS) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, source, number, size, source_size, target, quota, start in the source's stream), and the sources."""
    sized = stored(docs.select("doc_id", "source", size(F.col("text")).alias("size")), "sized")
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    bits = max(8, (-(-sized.count() // bucket_docs) - 1).bit_length())
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    d = sized.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    d = d.join(sources, d["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    totals = d.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("number", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("number", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(offsets, ["number", "bucket"])
    d = d.select("doc_id", "source", "number", "size", "source_size", "target", "quota", (F.col("offset") + F.coalesce(F.sum("size").over(own), F.lit(0))).alias("start"))
    return stored(d, "placed"), sources


def pieces(documents: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 42) -> DataFrame:
    """The mix: (shard, rank, doc_id, number, start, turn, word, words). Words [word, word + words) of a document, in the turn-th pass
    through its source; a shard's pieces are in the order of rank (its blocks by hash, then the words within)."""
    quotas, _ = shard_quotas(sources, block_words, shard_blocks, seed)
    tasks = max(SPREAD, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = quotas.filter("blocks > 0").repartition(tasks, "shard", "number").select("shard", "number", "total", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("place"))
    blocks = places.select("shard", "number", F.expr(permuted("place", "total", f"{seed}L, number")).alias("block"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))).alias("turn")
    p = documents.filter("size > 0").select("doc_id", "number", "start", "size", "quota", "source_size", turns)
    p = p.withColumn("from", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), "quota")).filter("from < to")
    p = p.select("*", F.explode(F.expr(f"sequence(from div {block_words}, (to - 1) div {block_words})")).alias("block"))
    at, end = F.greatest(F.col("from"), F.col("block") * block_words), F.least(F.col("to"), (F.col("block") + 1) * block_words)
    p = p.select("doc_id", "number", "start", "turn", "block", (at - F.col("from")).alias("word"), (end - at).alias("words"), at.alias("at"))
    rank = F.struct(F.xxhash64(F.lit(seed), "shard", "number", "block").alias("h"), "number", "at").alias("rank")
    # As many blocks as the corpus has: the planner takes them for few and would broadcast them.
    return p.join(blocks.hint("merge"), ["number", "block"]).select("shard", rank, "doc_id", "number", "start", "turn", "word", "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 42, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken (the words of all its pieces), pieces (how many) and the first and last shard that has one."""
    documents, sources = placed(docs, seed, bucket_docs)
    p = pieces(documents, sources, block_words, shard_blocks, seed)
    taken = p.groupBy("number", "start").agg(F.sum("words").alias("taken"), F.count("*").alias("pieces"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    own = F.when(F.col("size") > 0, F.col("start"))
    out = documents.withColumn("own", own).join(taken.withColumnRenamed("start", "own"), ["number", "own"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "size", "source", "source_size", "target", zero("taken"), zero("pieces"), "first_shard", "last_shard")


def mixed(docs: DataFrame) -> DataFrame:
    """docs, all columns, with size, source_size, target and taken, of which the mix takes at least a word.

    Columns of docs that have one of these four names keep their values under that name and an underscore (or more, if
    that is taken too). Rows with one doc_id, source and size have equal shares of what they are given together, so that they need no order.
    """
    given = ("size", "source_size", "target", "taken")
    names, used = {}, [*docs.columns, *given]
    for c in docs.columns:
        names[c] = free_name(c, *used) if c.lower() in given else c
        used.append(names[c])
    m = mix(docs).groupBy("doc_id", "source", "size").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("sum"), F.count("*").alias("rows"))
    m = m.select(F.struct(F.col("doc_id").alias("id"), "source", "size").alias("key"), F.struct("source_size", "target", F.expr("sum div rows").alias("taken")).alias("given")).filter("given.taken > 0")
    d = docs.select(F.struct(*docs.columns).alias("own"), F.struct(F.col("doc_id").alias("id"), "source", size(F.col("text")).alias("size")).alias("key"))
    on = [d["key"][c].eqNullSafe(m["key"][c]) for c in ("id", "source", "size")]
    own = [F.col("own")[c].alias(n) for c, n in names.items()]
    return d.join(m, on).select(*own, d["key"]["size"].alias("size"), *(F.col("given")[c].alias(c) for c in given[1:]))


def mixed_text(docs: DataFrame, parts: DataFrame, documents: DataFrame) -> DataFrame:
    """shard, rank, doc_id and the words of each piece joined by a blank; doc_id must be unique in docs."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    p = parts.select("shard", "rank", "doc_id", "word", "words")
    return p.join(docs.select("doc_id", "text"), "doc_id").select("shard", "rank", "doc_id", F.array_join(F.slice(words, F.col("word").cast("int") + 1, F.col("words").cast("int")), " ").alias("text"))
