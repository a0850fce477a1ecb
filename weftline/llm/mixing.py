"""Sources mixed to target weights: whole copies of documents by pivotal dependent rounding.

Every document of a source is due the same number of copies, target / size of the source. The whole part is taken; the
rest is a mass of words below the document's size. Two documents play against each other: mass moves from one to the
other until one of them has none or all of its size, either way with the chance that keeps what each can expect. So the
source's words stay what they are. Groups of documents are folded in arrays, large ones first; what each leaves over
plays in the groups of the next level, up to one group a source. Its last document is rounded to the nearest, so that a
source's words miss its target by half of that document at most.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm._ranges import in_ranges, repeated, rows_before
from weftline.llm._store import keep

#: Weights of the sources in order of their names, again and again.
WEIGHTS = (3, 1, 2)
#: Words taken, as a share of all words; and of a document or source at most.
SHARE, MOST = 1.5, 2.0
#: Documents that one array folds.
FAN_IN = 256
#: Mass is counted in this part of a word, in whole numbers: nothing is lost in sums.
UNIT = 1 << 20
#: Sources up to which their table is sent to all tasks; beyond, it is joined.
MOST_SENT = 100_000

_ITEM = "doc_id, size, n, mass"
#: One game of the mass ``a`` and the next item ``x``; u is the chance drawn for the two.
_GAME = """
aggregate(slice(items, 2, size(items)), named_struct('a', items[0], 'done', slice(array(struct(items[0] as item, 0 as up)), 1, 0)), (s, x) ->
  transform(array(named_struct(
      'a', s.a, 'x', x, 'total', s.a.mass + x.mass,
      'gain_a', least(s.a.size * {unit} - s.a.mass, x.mass), 'gain_x', least(s.a.mass, x.size * {unit} - x.mass),
      'u', (pmod(xxhash64({seed}, s.a.doc_id, s.a.size, x.doc_id, x.size), 1099511627776) + 0.5D) / 1099511627776D)), g ->
    transform(array(named_struct('g', g, 'to_a', g.u * (g.gain_a + g.gain_x) < g.gain_x)), h ->
      transform(array(named_struct('g', g, 'to_a', h.to_a, 'bound', if(h.to_a, g.a.size, g.x.size) * {unit})), k ->
        transform(array(named_struct('g', g, 'full', g.total >= k.bound, 'left', g.total - if(g.total >= k.bound, k.bound, 0L), 'a_ends', k.to_a = (g.total >= k.bound))), e ->
          named_struct('a', named_struct('rnd', if(e.a_ends, g.x, g.a).rnd, 'doc_id', if(e.a_ends, g.x, g.a).doc_id, 'size', if(e.a_ends, g.x, g.a).size, 'n', if(e.a_ends, g.x, g.a).n, 'mass', e.left),
                       'done', concat(s.done, array(struct(if(e.a_ends, g.a, g.x) as item, cast(e.full as int) as up))))
        )[0])[0])[0])[0])
"""


def word_count(text: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def source_targets(units: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, n_units, target`` by source; ``units`` has ``source, size, n``.

    Sources are ranked over ranges of their names. A target above ``most`` times its source's size stops there, and the
    excess goes to the others by weight, until none is above: one sum over the sources each time.
    """
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    ranged = in_ranges(sources, [F.col("source").asc_nulls_last()], "sources")
    before = rows_before(ranged.withColumn("all", F.lit(0)), ["all"], F.lit(1)).drop("all")  # a row for each range
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) + F.col("before") - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = keep(ranged.join(F.broadcast(before), "part").select("source", "source_size", "n_units", cycle[F.pmod(place, F.lit(len(weights))).cast("int")].alias("weight")), "weights")
    limit = F.col("source_size") * F.lit(most)
    whole = weighed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    wanted, level, stopped = (whole.s or 0) * share, 0.0, -1
    free = whole.w or 0.0
    capped = 0.0
    while free:
        level = (wanted - capped) / free
        above = F.col("weight") * F.lit(level) > limit
        r = weighed.agg(F.sum(F.when(above, limit).otherwise(0.0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(above.cast("int")).alias("n")).first()
        if r.n == stopped:
            break
        capped, free, stopped = r.capped, r.free, r.n
    return keep(weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), limit) if free else limit).drop("weight"), "targets")


def _due(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds what the source is due, and of each unit's n rows: ``base`` copies of all, one more of ``whole``, and the
    ``mass`` that is left for one more row."""
    named = sources.withColumnRenamed("source", "of")
    at = units.join(F.broadcast(named) if named.count() <= MOST_SENT else named, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = at.withColumn("base", F.floor(rate).cast("long"))
    one = F.least(F.round((rate - F.col("base")) * F.col("size") * F.lit(float(UNIT))).cast("long"), F.col("size") * F.lit(UNIT))
    at = at.withColumn("one", one).withColumn("full", F.col("size") * F.lit(UNIT))
    total = "cast(one as decimal(19, 0)) * cast(n as decimal(19, 0))"
    return at.withColumn("whole", F.expr(f"if(full > 0, cast(floor({total} / cast(full as decimal(19, 0))) as bigint), 0L)")).withColumn("whole", F.expr(f"whole - if(cast(whole as decimal(19, 0)) * cast(full as decimal(19, 0)) > {total}, 1L, 0L)")).withColumn("mass", F.expr(f"cast({total} - cast(whole as decimal(19, 0)) * cast(full as decimal(19, 0)) as bigint)")).drop("one", "full")


def _tree(pool: DataFrame, most_units: int, seed: int) -> list[DataFrame]:
    """The outcomes ``source, item, up`` of all levels; ``pool`` has ``source, n_units, doc_id, size, n, mass``."""
    done, level, groups = [], 0, F.col("n_units")
    while True:
        groups, most_units = F.ceil(groups / FAN_IN).cast("long"), -(-most_units // FAN_IN)
        rnd = F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size")
        dealt = pool.select("source", "n_units", groups.alias("groups"), F.pmod(rnd, groups).alias("bucket"), rnd.alias("rnd"), "doc_id", "size", "n", "mass")
        item = F.struct((-F.col("size")).alias("order"), "rnd", *[F.col(x) for x in _ITEM.split(", ")])
        met = dealt.groupBy("source", "n_units", "groups", "bucket").agg(F.sort_array(F.collect_list(item)).alias("items"))
        met = met.withColumn("items", F.transform("items", lambda x: F.struct(x["rnd"], x["doc_id"], x["size"], x["n"], x["mass"])))
        folded = keep(met.withColumn("end", F.expr(_GAME.format(unit=f"{UNIT}L", seed=f"{seed}"))).select("source", "n_units", "groups", "end"), f"mix-{level}")
        done.append(folded.select("source", F.explode("end.done").alias("x")).select("source", "x.item.doc_id", "x.item.size", "x.item.n", "x.up"))
        last = folded.select("source", "n_units", "groups", "end.a.doc_id", "end.a.size", "end.a.n", "end.a.mass")
        alone = last.filter("groups = 1")
        done.append(alone.select("source", "doc_id", "size", "n", (2 * F.col("mass") >= F.col("size") * F.lit(UNIT)).cast("int").alias("up")))
        if most_units <= 1:
            return done
        pool, level = last.filter("groups > 1").drop("groups"), level + 1


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 13) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row of ``docs`` (``doc_id, text, source``).

    ``size`` is in words, ``copies`` how often the mix has the document, ``taken`` = copies x size. A null text has no
    words, and texts without words have the copies of their source's whole part; a null source is a source, the last;
    null ids are ids. Rows alike in source, id and size share their copies out: they play as one, so that no number of
    them meets in one group. Draws are hashes of ids, sizes and ``seed``: runs agree. An empty table gives no rows.
    """
    sized = docs.select("source", "doc_id", word_count(F.col("text")).alias("size"))
    units = keep(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    sources = source_targets(units, weights, share, most)
    most_units = sources.agg(F.max("n_units")).first()[0] or 0
    due = _due(units, sources)
    settled = due.filter("mass = 0").select("source", "doc_id", "size", "n", F.lit(0).alias("up"))
    pool = due.filter("mass > 0").select("source", "n_units", "doc_id", "size", "n", "mass")
    for part in _tree(pool, most_units, seed) if most_units else []:
        settled = settled.unionByName(part)
    at = _due(settled, sources).drop("n_units", "mass")
    rows = repeated(at, "n", "i")
    copies = F.col("base") + (F.col("i") <= F.col("whole")).cast("long") + F.when(F.col("i") == F.col("whole") + 1, F.col("up")).otherwise(0)
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
