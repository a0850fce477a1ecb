"""Facts in lines of text as spans: several patterns, the leftmost longest hit, and which values labels bind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Signs of negative numbers; a sign counts next to its digits and not after a digit.
MINUS = "-‐–—−­"
NUMBER = rf"(?:(?<!\d)[{MINUS}])?\d+(?:\.\d+)?"
#: Pattern, what it stands for, and its expression over text in lower case.
PATTERNS = (
    ("hourly-label-v1", "hourly", r"\b(?:[01]?\d|2[0-3]):[0-5]\d\b"),
    ("hourly-label-v1", "hourly", r"\b(?:0?\d|1[0-2])\s*(?:am|pm)\b"),
    ("hourly-label-v1", "hourly", r"\b(?:[01]?\d|2[0-3])h\b"),
    ("max-label-v1", "max", r"\b(?:high|max|maximum|hi)\b"),
    ("min-label-v1", "min", r"\b(?:low|min|minimum|lo)\b"),
    ("temp-number-degree-v1", "temperature", NUMBER + r"\s*(?:°\s*[cf]?|℃|℉)"),
)


def hits(text: Column, pattern: str, category: str, expression: str) -> Column:
    """``start, longest, pattern, stop, category, hit`` of the matches of one expression. Their places follow from the lengths
    of the matches and of what lies between them."""
    found, between = F.regexp_extract_all(text, F.lit(expression), F.lit(0)), F.split(text, expression, -1)
    length = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))

    def span(p: Column, hit: Column, i: Column) -> Column:
        start = length(p["between"], i + 1) + length(p["found"], i)
        return F.struct(start.alias("start"), (-F.length(hit)).alias("longest"), F.lit(pattern).alias("pattern"), (start + F.length(hit)).alias("stop"), F.lit(category).alias("category"), hit.alias("hit"))

    once = F.array(F.struct(found.alias("found"), between.alias("between")))  # matched once, whatever the number of hits
    return F.get(F.transform(once, lambda p: F.transform(p["found"], lambda hit, i: span(p, hit, i))), F.lit(0))


def leftmost_longest(spans: Column) -> Column:
    """``start, stop, pattern, categories, hit`` of the spans that stay, in one fold with the end of the last one as state.

    Spans go by start, longest first; hits of the same span are one with both categories; what overlaps is dropped.
    """
    one = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["pattern"].alias("pattern"), F.array(x["category"]).alias("categories"), x["hit"].alias("hit"))
    none = F.array().cast("array<struct<start:int,stop:int,pattern:string,categories:array<string>,hit:string>>")

    def step(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        merged = F.struct(last["start"].alias("start"), last["stop"].alias("stop"), last["pattern"].alias("pattern"), F.array_union(last["categories"], F.array(x["category"])).alias("categories"), last["hit"].alias("hit"))
        same = (last["start"] == x["start"]) & (last["stop"] == x["stop"])
        return F.when((F.size(kept) == 0) | (x["start"] >= last["stop"]), F.concat(kept, F.array(one(x)))).when(same, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(merged))).otherwise(kept)

    return F.aggregate(F.array_sort(spans), none, step)


def fact_spans(lines: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """``keys, start, stop, pattern, namespace, voided, value, decimals, hour`` of the facts of each line.

    A span that is a label of both kinds is void. A null line has none.
    """
    low = F.lower(F.col(text))
    spans = reduce(F.concat, [hits(low, *p) for p in PATTERNS])
    rows = lines.select(*keys, F.explode(leftmost_longest(spans)).alias("x")).select(*keys, "x.*")
    has = lambda c: F.array_contains("categories", c)
    namespace = F.when(has("temperature"), "temperature").when(has("max"), "max-label").when(has("min"), "min-label").otherwise("hourly-label")
    number = F.when(namespace == "temperature", F.translate(F.regexp_extract("hit", NUMBER, 0), MINUS[1:], "-" * (len(MINUS) - 1)))
    first = F.regexp_extract("hit", r"^\d+", 0).cast("int")
    hour = F.when(namespace == "hourly-label", F.when(F.col("hit").endswith("pm"), first % 12 + 12).when(F.col("hit").endswith("am"), first % 12).otherwise(first))
    return rows.select(
        *keys, "start", "stop", "pattern", namespace.alias("namespace"), (~has("temperature") & has("max") & has("min")).alias("voided"),
        number.cast("decimal(18, 6)").alias("value"), F.when(number.isNotNull(), F.length(F.regexp_extract(number, r"\.(\d+)$", 1))).alias("decimals"), hour.alias("hour"),
    )


def bound_extremes(spans: DataFrame, lines: DataFrame, unit: str, line: str, text: str = "line") -> DataFrame:
    """``unit, branch, state, max_line, max_start, max_value, min_line, min_start, min_value`` of each unit of lines.

    Labels bind values by tree edges (0 in one line, 2 between lines), then by distance in the unit's text. With labels of
    both kinds the pair of different values with the least sums is taken, ties by the larger one's distance, the other's,
    and places. The nearest label of each value stands next to it in the order of places, and of all values only the two
    best of each side can be in the best pair, so that nothing is compared with everything. Labels of one kind bind one
    value and leave the other to the rest; three values or more are ambiguous then, as without labels.
    """
    # each line stands before its spans, with its length: one order of a unit's rows serves all that looks back and ahead
    marks = lines.select(unit, line, F.lit(-1).alias("start"), F.lit("line").alias("namespace"), F.lit(None).cast("decimal(18, 6)").alias("value"), F.coalesce(F.length(text), F.lit(0)).alias("size"))
    found = spans.filter(f"not voided and namespace <> 'hourly-label' and {unit} is not null and {line} is not null").select(unit, line, "start", "namespace", "value", F.lit(None).cast("int").alias("size"))
    rows, order = marks.union(found), Window.partitionBy(unit).orderBy(line, "start")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.sum("size").over(so_far) - F.last("size", ignorenulls=True).over(so_far) + F.col("start"))
    columns = {}
    for side in ("max", "min"):
        label = F.when(F.col("namespace") == f"{side}-label", F.col("at"))
        for w, name in ((Window.partitionBy(unit, line).orderBy("start"), "near"), (order, "far")):
            columns[f"{side}_{name}_before"] = F.last(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
            columns[f"{side}_{name}_after"] = F.first(label, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns(columns)
    closest = lambda side, name: F.least(F.col("at") - F.col(f"{side}_{name}_before"), F.col(f"{side}_{name}_after") - F.col("at"))
    temp, listed = F.col("namespace") == "temperature", {}
    for side in ("max", "min"):  # the two nearest to a label, and the two with the most extreme values
        near, far = closest(side, "near"), closest(side, "far")
        d = F.struct(F.when(near.isNotNull(), 0).when(far.isNotNull(), 2).alias("edges"), F.coalesce(near, far).alias("text"))
        listed[f"{side}_r"] = F.collect_list(F.when(temp, F.struct(d["edges"].isNull().alias("none"), d.alias("d"), F.col(line).alias("line"), "start", "value")))
        listed[f"{side}_v"] = F.collect_list(F.when(temp, F.struct((-F.col("value") if side == "max" else F.col("value")).alias("key"), F.col(line).alias("line"), "start", "value")))
    at = rows.groupBy(unit).agg(*[F.slice(F.array_sort(c), 1, 2).alias(name) for name, c in listed.items()], F.count_if(temp).alias("n"), *[F.max(F.col("namespace") == f"{s}-label").alias(f"has_{s}") for s in ("max", "min")])
    place = lambda x: F.when(x.isNotNull(), F.struct(x["line"].alias("line"), x["start"].alias("start"), x["value"].alias("value")))
    best_of = {f"{s}_{t}{k}": place(F.get(f"{s}_{t}", F.lit(k - 1))) for s in ("max", "min") for t in "rv" for k in (1, 2)}
    dist = {f"{s}_d{k}": F.when(~F.get(f"{s}_r", F.lit(k - 1))["none"], F.get(f"{s}_r", F.lit(k - 1))["d"]) for s in ("max", "min") for k in (1, 2)}
    at = at.select(unit, "n", "has_max", "has_min", *[c.alias(name) for name, c in (best_of | dist).items()])
    both, one = F.col("has_max") & F.col("has_min"), F.col("has_max") | F.col("has_min")
    n = F.col("n")
    branch = F.when(n == 0, "E-empty").when(both, "double-label").when(one, "single-label").otherwise("no-label")

    def option(i: int, j: int) -> Column:
        a, b, x, y = F.col(f"max_d{i}"), F.col(f"min_d{j}"), F.col(f"max_r{i}"), F.col(f"min_r{j}")
        key = F.struct((a["edges"] + b["edges"]).alias("edges"), (a["text"] + b["text"]).alias("text"), a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y"))
        return F.when((x["line"] != y["line"]) | (x["start"] != y["start"]), key)

    best = F.least(option(1, 1), option(1, 2), option(2, 1), option(2, 2))
    other = lambda chosen, side: F.when((F.col(f"{side}_v1")["line"] != chosen["line"]) | (F.col(f"{side}_v1")["start"] != chosen["start"]), F.col(f"{side}_v1")).otherwise(F.col(f"{side}_v2"))
    few = n < 3
    high = F.when(branch == "double-label", best["x"]).when((branch == "single-label") & few, F.when(F.col("has_max"), F.col("max_r1")).otherwise(other(F.col("min_r1"), "max"))).when((branch == "no-label") & few, F.col("max_v1"))
    low = F.when(branch == "double-label", best["y"]).when((branch == "single-label") & few, F.when(F.col("has_max"), other(F.col("max_r1"), "min")).otherwise(F.col("min_r1"))).when((branch == "no-label") & few, F.col("min_v1"))
    at = at.select(unit, branch.alias("branch"), high.alias("high"), low.alias("low"))
    state = F.when(F.col("branch") == "E-empty", "not-found").when(F.col("high").isNull() | F.col("low").isNull() | (F.col("high")["value"] == F.col("low")["value"]), "ambiguous").otherwise("bound")
    show = lambda x, side: [F.col(x)["line"].alias(f"{side}_line"), F.col(x)["start"].alias(f"{side}_start"), F.col(x)["value"].alias(f"{side}_value")]
    return at.select(unit, "branch", state.alias("state"), *show("high", "max"), *show("low", "min"))
