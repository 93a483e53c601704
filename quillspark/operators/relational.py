"""Joins, aggregations and rankings with parameters, on any tables. Joins are equi-joins; what decides them is compared after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# joins


def merge_hits(vector: DataFrame, keyword: DataFrame, id_: str = "id") -> DataFrame:
    """Hits of two searches by id: id, vector_score, text_score (0 where one lacks it), snippet (the keyword's unless empty)."""
    k = keyword.select(id_, F.col("score").alias("text_score"), F.col("snippet").alias("_k"))
    v = vector.select(id_, F.col("score").alias("vector_score"), F.col("snippet").alias("_v"))
    snippet = F.coalesce(F.when(F.col("_k") != "", F.col("_k")), F.col("_v"), F.col("_k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return v.join(k, id_, "full_outer").select(id_, zero("vector_score"), zero("text_score"), snippet.alias("snippet"))


def fuse(hits: DataFrame, vector_weight: float = 0.7, text_weight: float = 0.3, least: float = 0.35, most: int = 6) -> DataFrame:
    """The best hits by the weighted sum of their scores; weights are cut to 0..1 and made to add up to 1."""
    a, b = (min(1.0, max(0.0, w)) for w in (vector_weight, text_weight))
    a, b = (a / (a + b), b / (a + b)) if a + b > 0 else (0.7, 0.3)
    scored = hits.withColumn("score", F.lit(a) * F.col("vector_score") + F.lit(b) * F.col("text_score"))
    return scored.where(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(most)


def over_fetch(arms: list[DataFrame], most: int = 6, multiplier: int = 4) -> list[DataFrame]:
    """The best ``most * multiplier`` hits of each arm (id, score, ...), the multiplier cut to 1..20."""
    n = most * min(20, max(1, int(multiplier)))
    return [a.orderBy(F.col("score").desc(), "id").limit(n) for a in arms]


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the seen set; rows without a key stay."""
    return df.join(seen.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def seen_keys(keys: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().join(seen.select(key), key, "left_semi")


def priced(usage: DataFrame, pricing: DataFrame, keys: list[str], rates: dict[str, str], per: float = 1e6) -> DataFrame:
    """Adds ``cost``: each amount times its rate ``per`` a million, null where the model has no price."""
    amount = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0)) * F.coalesce(F.col(r), F.lit(0.0)) for n, r in rates.items()])
    known = pricing.select(*keys, *rates.values(), F.lit(True).alias("_priced"))
    return usage.join(known, keys, "left").withColumn("cost", F.when(F.col("_priced"), amount / per)).drop("_priced", *rates.values())


def looked_up(df: DataFrame, names: DataFrame, key: str, name: str, default: str | None = None) -> DataFrame:
    """Adds a name by its key; the first by name if the key has several."""
    one = names.groupBy(key).agg(F.min(name).alias(name))
    return df.join(one, key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def lookup_by_priority(df: DataFrame, id_: str, config: DataFrame, keys: Column, parents: Column, normalise, wildcard: str = "*") -> DataFrame:
    """id, key, value, source of the best entry of ``config`` (key, value): a key as it is, a key normalised, a parent as it is,
    a parent normalised, the wildcard. ``keys`` and ``parents`` are arrays, best first."""
    entries = config.select(F.col("key").alias("_entry"), F.col("value").alias("_value"))
    forms = entries.select("_entry", "_value", F.col("_entry").alias("_key"), F.lit(0).alias("_form")).union(
        entries.where(F.col("_entry") != wildcard).select("_entry", "_value", normalise(F.col("_entry")), F.lit(1)))
    at = lambda c, rank, source: F.transform(c, lambda x, i: F.struct(x.alias("key"), (F.lit(rank * 1000) + i).alias("rank"), F.lit(rank % 2).alias("form"), F.lit(source).alias("source")))
    plain = F.array(F.struct(F.lit(wildcard).alias("key"), F.lit(4000).alias("rank"), F.lit(0).alias("form"), F.lit("wildcard").alias("source")))
    wanted = F.concat(at(keys, 0, "direct"), at(F.transform(keys, normalise), 1, "direct"), at(parents, 2, "parent"), at(F.transform(parents, normalise), 3, "parent"), plain)
    asked = df.select(id_, F.explode(wanted).alias("w")).where("w.key is not null and w.key <> ''")
    found = asked.join(forms, (F.col("w.key") == F.col("_key")) & (F.col("w.form") == F.col("_form")))
    best = F.min(F.struct("w.rank", "_entry", F.col("_value").alias("value"), F.col("w.source").alias("source"))).alias("b")
    return found.groupBy(id_).agg(best).select(id_, F.col("b._entry").alias("key"), "b.value", "b.source")


def unreferenced(df: DataFrame, refs: DataFrame, key: str, ref: str) -> DataFrame:
    return df.join(refs.select(F.col(ref).alias(key)), key, "left_anti")


def append_if_absent(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """The base, and each extra row whose keys it lacks in any case (the first of equals)."""
    folded = lambda d: d.select(*[F.lower(F.trim(k)).alias("_" + k) for k in keys])
    new = extra.withColumns({"_" + k: F.lower(F.trim(k)) for k in keys}).join(folded(base), ["_" + k for k in keys], "left_anti")
    one = new.groupBy(*["_" + k for k in keys]).agg(F.min(F.struct(*extra.columns)).alias("r")).select("r.*")
    return base.select(extra.columns).union(one)


def linked_identity(df: DataFrame, id_: str, channel: Column, peer: Column, links: DataFrame) -> DataFrame:
    """id, canonical: of ``links`` (seq, canonical, aliases) the first with an alias that is the peer or ``channel:peer``."""
    fold = lambda c: F.lower(F.trim(c))
    named = links.where(F.trim("canonical") != "").select("seq", F.trim("canonical").alias("canonical"), F.explode("aliases").alias("alias"))
    named = named.select("seq", "canonical", fold(F.col("alias")).alias("alias")).where("alias <> ''")
    asked = df.where(F.trim(peer) != "").select(id_, F.explode(F.array_distinct(F.array(fold(peer), F.concat(fold(channel), F.lit(":"), fold(peer))))).alias("alias"))
    return asked.join(named, "alias").groupBy(id_).agg(F.min_by("canonical", "seq").alias("canonical"))


def node_key(c: Column) -> Column:
    """Lower case, all else but letters and digits as single hyphens within."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def node_matches(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """ask, node_id, connected of nodes (node_id, name, ip, connected) that a query (ask, q) names by id, address, normalised
    name, or the first six or more characters of the id. Four equi-joins, so no pair is formed that shares no key."""
    q = queries.select("ask", F.trim("q").alias("q")).where("q <> ''")
    n = nodes.select("node_id", "name", "ip", "connected")
    ways = [
        q.join(n, F.col("q") == F.col("node_id")), q.join(n, F.col("q") == F.col("ip")),
        q.join(n.where("name <> ''"), node_key(F.col("q")) == node_key(F.col("name"))),
        q.where(F.length("q") >= 6).join(n, F.substring("q", 1, 6) == F.substring("node_id", 1, 6)).where(F.col("node_id").startswith(F.col("q"))),
    ]
    return reduce(lambda a, b: a.union(b), [w.select("ask", "node_id", "connected") for w in ways]).distinct()


def resolve_one(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """ask, status (ok, unknown, ambiguous), node_id: the only match, or of several the only connected one."""
    on = F.coalesce(F.col("connected"), F.lit(False))
    m = matches.groupBy("ask").agg(
        F.count("*").alias("n"), F.count_if(on).alias("live"), F.min("node_id").alias("any_id"), F.min(F.when(on, F.col("node_id"))).alias("live_id")
    )
    chosen = F.when(F.col("n") == 1, F.col("any_id")).when(F.col("live") == 1, F.col("live_id"))
    status = F.when(F.col("n").isNull(), "unknown").when(chosen.isNotNull(), "ok").otherwise("ambiguous")
    return queries.select("ask").distinct().join(m, "ask", "left").select("ask", status.alias("status"), chosen.alias("node_id"))


def spawned_tree(df: DataFrame, key: str, parent: str, depth: int) -> DataFrame:
    """root, key, depth of all that a root (a row without a parent among the keys) spawned, to ``depth`` levels; a join a level."""
    edges = df.select(F.col(key).alias("key"), F.col(parent).alias("parent"))
    roots = edges.join(edges.select(F.col("key").alias("parent")), "parent", "left_anti")
    level = roots.select(F.col("key").alias("root"), "key", F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        level = level.select("root", F.col("key").alias("parent")).join(edges, "parent").select("root", "key", F.lit(d).alias("depth"))
        out = out.union(level)
    return out


# aggregations


def totals(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()])


def totals_by_each(df: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """The measures for each value of each dimension, and for all rows, in one pass: dimension, value, and the measures."""
    kinds = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions], F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value")))
    return df.withColumn("_d", F.explode(kinds)).groupBy("_d.dimension", "_d.value").agg(*[m.alias(n) for n, m in measures.items()])


def tokens_clamped(c: Column) -> Column:
    """Whole and not negative; null stays."""
    return F.when(c >= 0, F.floor(c).cast("long")).when(c < 0, F.lit(0).cast("long"))


def usage_rollup(df: DataFrame, job: str, model: str, tokens_in: str, tokens_out: str, total: str) -> DataFrame:
    """A row for each job: runs, no_usage (runs that report no tokens at all), tokens, and its models (model, runs, tokens) by
    tokens, most first. A missing total is input and output together."""
    has = F.coalesce(F.col(total).isNotNull() | F.col(tokens_in).isNotNull() | F.col(tokens_out).isNotNull(), F.lit(False))
    parts = tokens_clamped(F.coalesce(F.col(tokens_in), F.lit(0))) + tokens_clamped(F.coalesce(F.col(tokens_out), F.lit(0)))
    rows = df.select(F.col(job).alias("job"), F.coalesce(F.col(model), F.lit("unknown")).alias("model"), has.alias("has"), F.coalesce(tokens_clamped(F.col(total)), parts).alias("tokens"))
    by_model = rows.groupBy("job", "model").agg(F.count("*").alias("runs"), F.count_if(~F.col("has")).alias("no_usage"), F.sum("tokens").alias("tokens"))
    models = F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("less"), "model", "runs")))
    out = by_model.groupBy("job").agg(F.sum("runs").alias("runs"), F.sum("no_usage").alias("no_usage"), F.sum("tokens").alias("tokens"), models.alias("m"))
    return out.select("job", "runs", "no_usage", "tokens", F.transform("m", lambda x: F.struct(x["model"].alias("model"), x["runs"].alias("runs"), (-x["less"]).alias("tokens"))).alias("models"))


def current_model(days: DataFrame) -> DataFrame:
    """provider, day, model, cost of the latest day (day, breakdown: array of (model, cost), models_used) that has any: the
    dearest model, or the last one used where no breakdown is given."""
    top = F.array_max(F.transform(F.filter("breakdown", lambda x: x["cost"].isNotNull()), lambda x: F.struct(x["cost"].alias("cost"), x["model"].alias("model"))))
    known = days.withColumn("top", top).withColumn("model", F.coalesce("top.model", F.when(F.size("models_used") > 0, F.element_at("models_used", -1))))
    return known.where("model is not null").groupBy("provider").agg(F.max_by(F.struct("day", "model", F.col("top.cost").alias("cost")), "day").alias("r")).select("provider", "r.*")


def latency(df: DataFrame, by: list[str], session: str, value: str) -> DataFrame:
    """count, avg, least, most, p95 (the largest of the sessions' own) and true_p95 (over all values, exact)."""
    s = df.groupBy(*by, session).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.percentile(value, F.lit(0.95)).alias("p"))
    merged = s.groupBy(*by).agg(F.sum("n").alias("count"), (F.sum("s") / F.sum("n")).alias("avg"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.max("p").alias("p95"))
    return merged.join(df.groupBy(*by).agg(F.percentile(value, F.lit(0.95)).alias("true_p95")), by)


def by_frequency(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """value, n of the values that aren't blank, most frequent first, then by name."""
    v = df.select(F.trim(F.col(column).cast("string")).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    v = v.orderBy(F.col("n").desc(), "value")
    return v if most is None else v.limit(most)


def fill_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, rate (of rows where it isn't blank), n: one pass over all fields."""
    filled = lambda c: F.avg(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1.0).otherwise(0.0))
    row = df.agg(F.count("*").alias("n"), *[filled(c).alias("_" + c) for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col("_" + c).alias("rate")) for c in fields])
    return row.select(F.explode(pairs).alias("p"), "n").select("p.field", "p.rate", "n")


def gates(rates: DataFrame, least: dict[str, float], sample: int = 20) -> DataFrame:
    """Adds ``limit`` and ``ok`` to fill rates: a field below its limit fails, unless there are fewer than ``sample`` rows."""
    limit = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(v))) for f, v in least.items()], F.lit(0.0))
    return rates.withColumn("limit", limit).withColumn("ok", (F.col("n") < sample) | (F.col("rate") >= F.col("limit")))


def absorb(store: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """key, status of what a batch does to a store: added, touched or kept."""
    a, b = store.select(key, F.lit(1).alias("_a")).distinct(), news.select(key, F.lit(1).alias("_b")).distinct()
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNotNull(), "touched").otherwise("kept")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def longest_with_sources(df: DataFrame, key: str, text: str, source: str, id_: str) -> DataFrame:
    """A row for each key: the id of its longest text (the first of equals), that length, its sources in order, copies."""
    best = F.max(F.struct(F.length(text).alias("n"), (-F.col(id_)).alias("less")))
    return df.groupBy(key).agg(best.alias("b"), F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("copies")).select(
        key, (-F.col("b.less")).alias(id_), F.col("b.n").alias("length"), "sources", "copies")


def metric_snapshot(df: DataFrame, name: str, label: str, value: str, ts: str, gauges: list[str]) -> DataFrame:
    """name, label, value: the sum of a counter, the last value of a gauge. Partial aggregates, so five names take no more than a row each a task."""
    last = F.max(F.struct(ts, value))[value]
    return df.groupBy(name, label).agg(F.when(F.first(F.col(name).isin(gauges)), last).otherwise(F.sum(value)).alias("value"))


def latest_state_totals(df: DataFrame, key: str, ts: str, tie: str, state: str, states: list[str]) -> DataFrame:
    """How many keys are in each of the states now."""
    now = df.groupBy(key).agg(F.max(F.struct(ts, tie, state))[state].alias("_s"))
    return now.agg(*[F.count_if(F.col("_s") == s).alias(s) for s in states], F.count("*").alias("keys"))


def tool_summary(text: Column) -> Column:
    """Struct (tools: array of (name, n) by n, most first, then by name; calls; clean: the other lines) of a transcript's text."""
    name = lambda line: F.regexp_extract(F.trim(line), r"^\[Tool:\s*([^\]]+)\]", 1)
    lines = F.split(text, "\n")
    names = F.filter(F.transform(lines, name), lambda n: n != "")
    counted = F.transform(F.array_distinct(names), lambda n: F.struct((-F.size(F.filter(names, lambda m: m == n))).alias("less"), n.alias("name")))
    tools = F.transform(F.array_sort(counted), lambda x: F.struct(x["name"].alias("name"), (-x["less"]).alias("n")))
    clean = F.trim(F.array_join(F.filter(lines, lambda x: (name(x) == "") & ~F.trim(x).startswith("[Tool Result]")), "\n"))
    return F.struct(tools.alias("tools"), F.size(names).alias("calls"), clean.alias("clean"))


def between_swapped(ts: Column, start, end) -> Column:
    """Inclusive, whichever end comes first."""
    a, b = F.lit(start), F.lit(end)
    return ts.between(F.least(a, b), F.greatest(a, b))


# rankings


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; the rank filter is pushed below the exchange."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def rolling_history(df: DataFrame, key: str, ts: str, tie: str, limit: int, most_keys: int) -> DataFrame:
    """The last ``limit`` rows of each of the ``most_keys`` keys used last. The keys are cut by a top-k, not one window over all."""
    recent = df.groupBy(key).agg(F.max(ts).alias("_last")).orderBy(F.col("_last").desc(), key).limit(most_keys).select(key)
    return newest(df.join(recent, key, "left_semi"), [key], [F.col(ts).desc(), F.col(tie).desc()], limit)


def capped_history(df: DataFrame, key: str, order: list[str], size: str, most: int) -> DataFrame:
    """Adds ``kept``: the newest rows of a key that fit ``most`` together; and ``placeholder``: the newest alone is too large,
    so a note stands in its place."""
    down = [F.col(c).desc() for c in order]
    used = F.sum(size).over(W.partitionBy(key).orderBy(*down).rowsBetween(W.unboundedPreceding, 0))
    first = F.row_number().over(W.partitionBy(key).orderBy(*down)) == 1
    return df.withColumn("kept", used <= most).withColumn("placeholder", first & (F.col(size) > most))


def round_robin(df: DataFrame, cooling_until: str, now: Column, kind: str, kinds: list[str], last_used: str, id_: str) -> DataFrame:
    """Rows in the order to be tried: available ones by kind, then longest unused; then those cooling, soonest first."""
    cooling = F.coalesce(F.col(cooling_until) > now, F.lit(False))
    rank = F.coalesce(*[F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(len(kinds)))
    first = F.when(~cooling, rank)
    return df.withColumn("cooling", cooling).withColumn("kind_rank", rank).orderBy("cooling", first.asc_nulls_last(), F.when(~cooling, F.col(last_used)).asc_nulls_first(), F.when(cooling, F.col(cooling_until)), id_)


def prune_context(df: DataFrame, key: str, order: str, role: str, text: str, prunable: Column, window_chars: int, keep: int = 3, soft_ratio: float = 0.3, hard_ratio: float = 0.5,
                  least: int = 50_000, trim: tuple[int, int, int] = (4000, 1500, 1500), cleared: str = "[Old tool result content cleared]") -> DataFrame:
    """key, order, role, action (kept, trimmed, cleared) and text after pruning old tool results of a conversation to its window.

    Nothing before the first user turn nor from the ``keep``-th last assistant turn on is touched, and nothing at all if there are
    fewer. From ``soft_ratio`` of the window on, prunable results over ``trim[0]`` characters keep a head and a tail; if what
    is left still fills ``hard_ratio``, and prunable results hold ``least`` characters, they are cleared from the oldest on until
    it doesn't. Windows over one conversation."""
    all_rows, up = W.partitionBy(key), W.partitionBy(key).orderBy(order)
    after = F.sum(F.when(F.col(role) == "assistant", 1).otherwise(0)).over(W.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0))
    users = F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(up.rowsBetween(W.unboundedPreceding, 0))
    n = F.length(F.coalesce(text, F.lit("")))
    size = F.when(F.col(role).isin("user", "assistant", "toolResult"), n).otherwise(256)
    # before the tail that the last ``keep`` assistant turns open; without so many turns there is no tail, and nothing is pruned
    turns = F.sum(F.when(F.col(role) == "assistant", 1).otherwise(0)).over(all_rows)
    old = ((turns >= keep) & (after >= keep) & ~((after == keep) & (F.col(role) == "assistant"))) if keep > 0 else F.lit(True)
    can = old & (users > 0) & (F.col(role) == "toolResult") & prunable
    d = df.select(key, order, role, F.coalesce(text, F.lit("")).alias("_t"), size.alias("_size"), can.alias("_can"))
    most, head, tail = trim
    note = F.concat(F.substring("_t", 1, head), F.lit("\n...\n"), F.substring("_t", -tail, tail), F.lit(f"\n\n[Tool result trimmed: kept first {head} chars and last {tail} chars of "), F.length("_t").cast("string"), F.lit(" chars.]"))
    d = d.withColumn("_full", F.sum("_size").over(all_rows))
    soft = F.col("_can") & (F.col("_full") >= soft_ratio * window_chars) & (F.length("_t") > most) & (F.length("_t") > head + tail)
    d = d.withColumn("_trim", soft).withColumn("_t2", F.when(soft, note).otherwise(F.col("_t")))
    d = d.withColumn("_size2", F.when(F.col("_trim"), F.length("_t2")).otherwise(F.col("_size")))
    d = d.withColumn("_full2", F.sum("_size2").over(all_rows)).withColumn("_held", F.sum(F.when(F.col("_can"), F.col("_size2")).otherwise(0)).over(all_rows))
    freed = F.coalesce(F.sum(F.when(F.col("_can"), F.col("_size2") - len(cleared)).otherwise(0)).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hard = F.col("_can") & (F.col("_full") >= soft_ratio * window_chars) & (F.col("_held") >= least) & (F.col("_full2") - F.col("_freed") >= hard_ratio * window_chars)
    d = d.withColumn("_freed", freed).withColumn("_hard", hard)
    action = F.when(F.col("_hard"), "cleared").when(F.col("_trim"), "trimmed").otherwise("kept")
    return d.select(key, order, role, action.alias("action"), F.when(F.col("_hard"), F.lit(cleared)).otherwise(F.col("_t2")).alias(text))


def ttl_then_cap(df: DataFrame, keys: list[str], ts: Column, tie: str, cutoff: Column, most: int, keep_undated: bool = False) -> DataFrame:
    """Rows no older than the cutoff, then the newest ``most`` of each key; undated rows go first, or survive the first step."""
    alive = F.coalesce(ts >= cutoff, F.lit(keep_undated))
    return newest(df.where(alive), keys, [ts.desc_nulls_last(), F.col(tie).desc()], most)


def vote_of(selections: Column, options: int, most: int) -> Column:
    """Selections that are whole numbers of an option, at most ``most``, each once."""
    whole = F.transform(selections, lambda x: F.regexp_extract(F.trim(x), r"^[+-]?\d+", 0).try_cast("int"))
    valid = F.filter(whole, lambda x: (x >= 0) & (x < options))
    return F.array_distinct(F.transform(F.slice(valid, 1, max(1, most)), lambda x: x.cast("string")))


def worst_status(requested: DataFrame, rows: DataFrame, key: str, status: str, order: list[str], expires: str) -> DataFrame:
    """key, status (the worst of its rows', ``missing`` without any), expires (the earliest) of each requested key."""
    rank = F.coalesce(*[F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    worst = rows.groupBy(key).agg(F.min(rank).alias("_r"), F.min(expires).alias("expires"))
    # branches on the rank itself: Spark gives an element, not null, for a null place in an array of constants
    named = reduce(lambda c, n: c.when(F.col("_r") == n, F.lit(order[n])), range(len(order)), F.when(F.col("_r").isNull(), F.lit("missing"))).otherwise(F.lit("other"))
    return requested.select(key).distinct().join(worst, key, "left").select(key, named.alias("status"), "expires")


def top_with_omitted(groups: DataFrame, value: str, name: str, n: int) -> DataFrame:
    """The ``n`` largest of the groups, and how many were left out: a top-k and a count, no window over all groups."""
    total = groups.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("omitted"))
    return groups.orderBy(F.col(value).desc(), name).limit(n).join(total)


def per_key_summary(df: DataFrame, key: str, order: list[str], id_: str, n: int) -> DataFrame:
    """key, id, rank, total of the ``n`` most recent rows of each key; the count is an aggregate of its own, so no task sorts a
    whole key."""
    down = [F.col(c).desc() for c in order]
    top = df.select(key, id_, *order, F.row_number().over(W.partitionBy(key).orderBy(*down)).alias("rank")).where(F.col("rank") <= n)
    return top.join(df.groupBy(key).agg(F.count("*").alias("total")), key).select(key, id_, "rank", "total")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch and at (place in it): ranks in two levels, by ranges of the order and within them, so no task holds all rows."""
    spread = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = df.repartitionByRange(int(spread), order).withColumn("_p", F.spark_partition_id())
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).select("_p", "_before")  # a row a partition
    ranked = parts.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1).join(before, "_p")
    at = F.col("_before") + F.col("_k")
    return ranked.withColumn("batch", F.floor(at / size).cast("int")).withColumn("at", (at % size).cast("int")).drop("_p", "_k", "_before")


def search_additive(df: DataFrame, text: str, tag: str, words: list[str], whole: int = 10, each: int = 5, tagged: int = 3, most: int = 10) -> DataFrame:
    """The best rows by a sum: the whole phrase in the text, each of its words, and its words in the tag; 0 is no match."""
    phrase = " ".join(words).lower()
    hit = lambda c, w: F.when(F.contains(F.lower(F.col(c)), F.lit(w.lower())), 1).otherwise(0)
    score = hit(text, phrase) * whole + reduce(lambda a, b: a + b, [hit(text, w) * each + hit(tag, w) * tagged for w in words])
    return df.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), *df.columns[:1]).limit(most)


def learned(table: DataFrame, pairs: DataFrame, order: list[str]) -> DataFrame:
    """facet, key, id, label, changed: a table of ids by facet and label after pairs (facet, label, id) are folded in by order.
    A label's key is its lower case with single spaces; a pair that lacks a part, or repeats the id known, changes nothing, and
    ``changed`` tells whether any pair did. One shuffle by facet and key."""
    part = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    both = table.select("facet", "label", "id", F.lit(0).alias("_new"), F.struct(*[F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in order]).alias("_at"))
    news = pairs.select(part("facet").alias("facet"), part("label").alias("label"), part("id").alias("id"), F.lit(1).alias("_new"), F.struct(*order).alias("_at"))
    rows = both.union(news.where("facet <> '' and label <> '' and id <> ''")).withColumn("key", F.regexp_replace(F.lower(F.trim("label")), r"\s+", " "))
    before = F.lag("id").over(W.partitionBy("facet", "key").orderBy("_new", "_at"))
    steps = rows.withColumn("_step", (F.col("_new") == 0) | before.isNull() | (before != F.col("id"))).where("_step")
    last = lambda c: F.max_by(c, F.struct("_new", "_at"))
    return steps.groupBy("facet", "key").agg(last("id").alias("id"), last("label").alias("label"), (F.max("_new") == 1).alias("changed"))


def chunks_of(df: DataFrame, model: str, sources: list[str] = ()) -> DataFrame:
    """Chunks of a model and, if any are named, of these sources; both filters reach the scan."""
    df = df.where(F.col("model") == model)
    return df.where(F.col("source").isin(list(sources))) if sources else df


def collated_rank(df: DataFrame, keys: list[str], name: str, tie: str) -> DataFrame:
    """Adds ``rank``: the place of a name among its key's in Unicode order without regard to case."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.collate(F.col(name), "UNICODE_CI"), tie)))
