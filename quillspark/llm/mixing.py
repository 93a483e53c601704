"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share ``SHARE`` times all words by weight; no
target exceeds ``EPOCHS`` times its source's words, and what is cut off goes to the others by weight. That is one water
level for all sources, found from running sums over the sources sorted by the level at which each is full.

Schedule: slot i holds the golden-ratio point ``(i + 1) * STEP mod 2**62`` (whole numbers, so that a point is exact at any i),
which falls into one source's interval of the cumulative slot counts; so every stretch of the schedule has each source in its
share. A slot's rank within its source names a block of ``BLOCK`` words of the source's stream: its documents in the order of a
keyed hash, laid end to end, an epoch after an epoch. The last block taken is cut where the target ends. A source whose points
are more than its slots (discrepancy: a few) leaves the last ones empty, and slots that a source still lacks are appended.
``blocks_taken`` is the schedule with its blocks; a document's ``first_slot`` and ``slots`` say where in it its words stand.
Ranks and stream positions are running sums in two levels (hash range or run of slots, then within it), so a hot source is
spread over all tasks; ranges and runs grow in number and length with the square root of the slots.

Nulls: a null text has no words; a null source is a source of its own; a null doc_id is a row like any other. Rows that
repeat are separate documents. A document without words takes nothing, and has no slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, materialize, table

WEIGHTS, SHARE, EPOCHS, BLOCK, RUN, SEED = (5, 2, 1), 1.5, 2, 256, 1 << 12, "mix-1"
#: The golden ratio's fraction of 2**62, odd.
STEP, TURN = 2850178704830799621, 62
HALF = 1 << 31


def sized(docs: DataFrame, named: bool = False) -> DataFrame:
    """doc_id, source, size (words) and the shuffle key of each row; ``named``: also name, 128 bits that name its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("key"),
        *([F.unhex(F.md5(text)).alias("name")] if named else []),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """A row for each source: sid, source, source_size, target, quota (whole words), blocks, need (slots).

    Its windows run over sources, not documents."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, all_rows = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1)
    t = totals.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", weight.cast("double"))
    t = t.withColumn("cap", (F.lit(epochs) * F.col("source_size")).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = W.orderBy("full_at", "sid").rowsBetween(W.unboundedPreceding, -1)
    t = (
        t.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    )
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "sid", "level"))).over(all_rows)["level"]
    t = t.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")))
    t = t.withColumn("quota", F.floor("target")).withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    need = F.expr(f"if(source_size = 0, 0L, quota div source_size * blocks + (quota % source_size + {block - 1}) div {block})")
    return t.select("sid", "source", "source_size", "target", "quota", "blocks", need.alias("need"))


def point(n) -> F.Column:
    """``n * STEP mod 2**62`` of a number under 2**61, in longs: by halves of 31 bits no product overflows."""
    lo, hi = STEP % HALF, STEP // HALF
    n_lo, n_hi = n.bitwiseAND(F.lit(HALF - 1)), F.shiftright(n, 31)
    upper = (n_hi * F.lit(lo) % F.lit(HALF) + n_lo * F.lit(hi) % F.lit(HALF)) % F.lit(HALF) * F.lit(HALF)
    low = n_lo * F.lit(lo)
    # upper and low are under 2**62 each, so their sum is a long
    return (upper + low) % F.lit(1 << TURN)


def schedule(mix: DataFrame, run: int | None = None) -> DataFrame:
    """The slots: slot, sid, rank (of the slot within its source)."""
    n = mix.agg(F.sum("need")).first()[0] or 0
    run = run or max(RUN, int(n**0.5))
    spark, shift = mix.sparkSession, TURN - 10
    # a source's interval of points: its cumulative share of the slots, in units of 2**-62
    edge = lambda c: F.expr(f"cast(cast({c} as decimal(38,0)) * {1 << TURN} div {max(1, n)} as bigint)")
    ends = mix.where("need > 0").withColumn("hi", F.sum("need").over(W.orderBy("sid"))).withColumn("lo", F.expr("hi - need"))
    ends = ends.select("sid", edge("lo").alias("lo"), edge("hi").alias("hi"))
    cells = ends.select("sid", "lo", "hi", F.explode(F.expr(f"sequence(shiftright(lo, {shift}), shiftright(hi - 1, {shift}))")).alias("bin"))
    slots = spark.range(n).withColumn("p", point(F.col("id") + 1)).withColumn("bin", F.expr(f"shiftright(p, {shift})"))
    slots = slots.join(cells, "bin").where("p >= lo and p < hi").select("id", "sid", F.expr(f"id div {run}").alias("run"))
    counts = slots.groupBy("sid", "run").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("sid").orderBy("run")) - F.col("n")).drop("n")
    within = F.row_number().over(W.partitionBy("sid", "run").orderBy("id")) - 1
    ranked = slots.withColumn("k", within).join(before, ["sid", "run"]).select("id", "sid", (F.col("before") + F.col("k")).alias("rank"))
    ranked = ranked.join(mix.select("sid", "need"), "sid").where("rank < need").drop("need")
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    short = mix.join(have, "sid", "left").select("sid", "need", F.expr("least(need, coalesce(have, 0L))").alias("have")).where("need > have")
    short = short.withColumn("start", F.lit(n) + F.sum(F.expr("need - have")).over(W.orderBy("sid")) - F.expr("need - have"))
    late = short.select("sid", "start", "have", F.explode(F.expr("sequence(have, need - 1)")).alias("rank"))
    return ranked.select(F.col("id").alias("slot"), "sid", "rank").union(late.selectExpr("start + rank - have", "sid", "rank"))


def blocks_taken(mix: DataFrame, block: int = BLOCK) -> DataFrame:
    """The schedule with what each slot takes: slot, sid, block (its number in the source's stream), words (from its start)."""
    return schedule(mix).join(mix, "sid").select(
        "slot", "sid", F.expr("rank % blocks").alias("block"),
        F.expr(f"least({block}L, source_size - rank % blocks * {block}, quota - rank div blocks * source_size - rank % blocks * {block})").alias("words"),
    )


def streams(sizes: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents in their source's stream: words lo to hi of it, row (with part: unique in a source)."""
    slots = mix.agg(F.sum("need")).first()[0] or 0
    digits = 3 if slots < 1 << 32 else 4  # hash ranges: 4096, then 65,536
    d = sizes.join(mix.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).withColumn("part", F.substring("key", 1, digits))
    parts = d.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(W.partitionBy("sid").orderBy("part")) - F.col("n")).drop("n")
    name = [c for c in sizes.columns if c == "name"]
    order = W.partitionBy("sid", "part").orderBy("key", "doc_id", "size", *name)
    d = d.withColumn("row", F.row_number().over(order)).withColumn("hi", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return d.join(parts, ["sid", "part"]).select("doc_id", "size", *name, "sid", "part", "row", F.expr("before + hi - size").alias("lo"), F.expr("before + hi").alias("hi"))


def mix_words(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK, named: bool = False) -> DataFrame:
    """A row for each document: doc_id, size, source, source_size, target, taken, first_slot (null: none), slots; ``named``: also name."""
    sizes = materialize(sized(docs, named))
    name = ["name"] if named else []
    mix = materialize(targets(sizes, weights, share, epochs, block))
    pieces = streams(sizes, mix).withColumn("block", F.explode_outer(F.expr(f"if(size > 0, sequence(lo div {block}, (hi - 1) div {block}), null)")))
    # least() and greatest() skip nulls, so a block that no slot takes has to be told apart
    overlap = F.expr(f"if(words is null, 0L, greatest(0L, least(hi, block * {block} + words) - greatest(lo, block * {block})))")
    pieces = pieces.join(blocks_taken(mix, block), ["sid", "block"], "left").withColumn("overlap", overlap)
    taken = pieces.groupBy("sid", "part", "row", "doc_id", "size", *name).agg(
        F.sum("overlap").alias("taken"), F.min(F.when(F.col("overlap") > 0, F.col("slot"))).alias("first_slot"), F.count_if(F.col("overlap") > 0).alias("slots")
    )
    return taken.join(mix, "sid").select("doc_id", "size", "source", "source_size", "target", "taken", "first_slot", "slots", *name)


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of which the mix takes words, with all their columns, and size, taken (words, repeats counted) and
    first_slot, by which the mix is read in its order.

    A row is told by its doc_id and its text. Rows equal in both share evenly what the mix takes of them (the first ones have a word more),
    and have the same first_slot. Columns of the input with one of these three names go on as ``given_size``, ``given_taken`` and
    ``given_first_slot``. The key is one string that is never null, so the join's exchange serves the window as well."""
    made = ("size", "taken", "first_slot")
    key = lambda name: F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.lit(":"), name)
    taken = mix_words(docs, named=True).groupBy(key(F.lower(F.hex("name"))).alias("__quill_key")).agg(
        F.max("size").alias("__quill_size"), F.sum("taken").alias("__quill_all"), F.count("*").alias("__quill_rows"), F.min("first_slot").alias("__quill_first_slot")
    )
    docs = docs.withColumnsRenamed({c: "given_" + c for c in docs.columns if c.lower() in made})
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    both = docs.withColumn("__quill_key", key(F.md5(text))).join(taken.where("__quill_all > 0"), "__quill_key")
    both = both.withColumn("__quill_nth", F.row_number().over(W.partitionBy("__quill_key").orderBy("__quill_key")))
    both = both.withColumn("__quill_taken", F.expr("__quill_all div __quill_rows + if(__quill_nth <= __quill_all % __quill_rows, 1L, 0L)")).where("__quill_taken > 0")
    return both.select(*docs.columns, *[F.col("__quill_" + c).alias(c) for c in made])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(table(spark, sf_dir, "documents")).drop("source")


SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  md5('mix-1:' || coalesce(doc_id::varchar, 'null')) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) as sid from s),
c as (select *, [5.0, 2.0, 1.0][(sid - 1) % 3 + 1]::double as weight, (2 * source_size)::double as cap from w),
l as (select *, cap / weight as full_at, sum(source_size) over ()::double * 1.5::double as total,
             coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0) as filled,
             sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0) as left_weight
      from c),
v as (select *, (select (total - filled) / left_weight from l where (total - filled) / left_weight <= full_at order by full_at, sid limit 1) as level from l),
t as (select sid, source, source_size, least(cap, coalesce(level * weight, cap)) as target, floor(least(cap, coalesce(level * weight, cap)))::bigint as quota from v),
b as (select *, (source_size + 255) // 256 as blocks,
             case when source_size = 0 then 0 else quota // source_size * ((source_size + 255) // 256) + (quota % source_size + 255) // 256 end as need from t),
e as (select *, sum(need) over () as n, sum(need) over (order by sid) as reach from b),
i as (select *, (reach - need)::hugeint * 4611686018427387904 // n as lo, reach::hugeint * 4611686018427387904 // n as hi from e where need > 0),
r as (select unnest(range(coalesce(max(n), 0)::bigint)) as id from e),
g as (select id, (id + 1)::hugeint * 2850178704830799621 % 4611686018427387904 as p from r),
h as (select g.id as slot, i.sid, row_number() over (partition by i.sid order by g.id) - 1 as rank from g join i on g.p >= i.lo and g.p < i.hi),
f as (select e.sid, e.need, least(e.need, coalesce(x.have, 0)) as have, e.n from e left join (select sid, count(*) as have from h group by sid) x on x.sid = e.sid),
z as (select *, n + sum(need - have) over (order by sid) - (need - have) as start from f where need > have),
o as (select h.slot, h.sid, h.rank from h join b on h.sid = b.sid where h.rank < b.need
      union all select start + r - have, sid, r from (select *, unnest(range(have::bigint, need::bigint)) as r from z)),
k as (select o.slot, b.sid, o.rank % blocks * 256 as first,
             o.rank % blocks * 256 + least(256, source_size - o.rank % blocks * 256, quota - o.rank // blocks * source_size - o.rank % blocks * 256) as last
      from o join b on o.sid = b.sid),
p as (select d.doc_id, d.size, b.sid, b.source_size, b.target,
             sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows unbounded preceding)::bigint as hi
      from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       coalesce(sum(case when k.slot is not null then least(p.hi, k.last) - greatest(p.hi - size, k.first) end), 0)::bigint as taken, min(k.slot)::bigint as first_slot, count(k.slot) as slots
from p left join k on p.sid = k.sid and k.first < p.hi and k.last > p.hi - size
group by doc_id, size, source_size, target
"""
QUERIES, ORACLES = {"op8_mixing": op8_mixing}, {"op8_mixing": SQL}
