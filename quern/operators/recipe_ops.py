"""The seventeen recipe operations as pairs: ``fit_<op>(df, p)`` learns a JSON-able state, ``<op>(df, p, state)`` applies it.

Operations that learn nothing have no ``fit_``.  Only Spark is imported, and helpers stand in this module, so that
an exported recipe can carry the source of what it uses.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def present(df, names):
    return [c for c in names if c in df.columns]


def rename_free(df, name):
    return f"`{name}`"


def row_order(df, key):
    """Order of rows that no other column decides: the key's, or a hash of the whole row."""
    return [F.col(rename_free(df, c)) for c in key] if key else [F.xxhash64(*[F.col(rename_free(df, c)) for c in df.columns])]


def drop(df, p, state=None):
    return df.drop(*present(df, p["columns"]))


def dedupe(df, p, state=None):
    """First row of each group of equal rows (in ``key`` order), or any of rows equal in all columns."""
    subset = p.get("subset")
    if not subset:
        return df.dropDuplicates()
    # an aggregate, so that a large group shrinks to a row in each task before it is shuffled
    first = F.min_by(F.struct("*"), F.struct(*row_order(df, p.get("key")))).alias("_first")
    return df.groupBy(*[F.col(rename_free(df, c)).alias(f"_by{i}") for i, c in enumerate(subset)]).agg(first).select("_first.*")


def parsed_number(c, kind):
    if kind == "boolean":
        return c.cast("double")
    text = F.regexp_replace(c.cast("string"), r"[,\s$€£¥%_]", "")
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def parsed_moment(c):
    """A date or time written in text: ISO with or without time, fraction and zone, or with slashes, dots or month names."""
    text = F.trim(c.cast("string"))
    shape = r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2} [A-Za-z]{3,9} \d{4}|[A-Za-z]{3,9} \d{1,2},? \d{4})([T ].*)?$"
    days = ["yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d.M.yyyy", "yyyy.M.d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy"]
    formats = [f"{d}[ HH:mm[:ss]]" for d in days]
    return F.when(text.rlike(shape), F.coalesce(text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in formats]))


def cast(df, p, state=None):
    kinds = dict(df.dtypes)
    for n in present(df, p["columns"]):
        c = F.col(rename_free(df, n))
        to = p["to"]
        new = parsed_number(c, kinds[n]) if to == "numeric" else parsed_moment(c) if to == "datetime" else c.cast("string")
        df = df.withColumn(n, new)
    return df


def fit_impute(df, p):
    how, names = p.get("strategy", "median"), present(df, p["columns"])
    if how in ("constant", "drop_rows") or not names:
        return {"values": {n: p.get("value", 0) for n in names}}
    if how == "most_frequent":
        exprs = [F.mode(F.col(rename_free(df, n)), True).alias(n) for n in names]
    elif how == "mean":
        exprs = [F.avg(rename_free(df, n)).alias(n) for n in names]
    else:
        exprs = [F.percentile(F.col(rename_free(df, n)), F.lit(0.5)).alias(n) for n in names]
    row = df.agg(*exprs).first()
    return {"values": {n: row[n] for n in names if row[n] is not None}}


def impute(df, p, state):
    names = present(df, p["columns"])
    if p.get("strategy") == "drop_rows":
        return df.dropna(subset=names)
    kinds = dict(df.dtypes)
    for n in names:
        if n in state["values"]:
            kind = kinds[n] if kinds[n] in ("string", "boolean", "timestamp", "timestamp_ntz", "date") else "double"
            df = df.withColumn(n, F.coalesce(F.col(rename_free(df, n)).cast(kind), F.lit(state["values"][n]).cast(kind)))
    return df


def fit_clip(df, p):
    lo, hi = p.get("lower_quantile", 0.01), p.get("upper_quantile", 0.99)
    if not 0 <= lo < hi <= 1:
        raise ValueError(f"clip: quantiles must satisfy 0 <= {lo} < {hi} <= 1")
    names = present(df, p["columns"])
    row = df.agg(*[F.percentile(F.col(rename_free(df, n)), F.array(F.lit(lo), F.lit(hi))).alias(f"q{i}") for i, n in enumerate(names)]).first() if names else ()
    return {"limits": {n: list(q) for n, q in zip(names, row, strict=True) if q}}


def clip(df, p, state):
    for n, (lo, hi) in state["limits"].items():
        c = F.col(rename_free(df, n)).cast("double")
        df = df.withColumn(n, F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c))))
    return df


def fit_encode(df, p):
    values = {}
    for n in present(df, p["columns"]):
        c = F.col(rename_free(df, n))
        rows = df.where(c.isNotNull()).select(c.alias("v")).distinct().orderBy("v").limit(p.get("max_values", 1000) + 1).collect()
        if len(rows) > p.get("max_values", 1000):
            raise ValueError(f"encode: {n} has more than {p.get('max_values', 1000)} values; use target-encode or raise max_values")
        values[n] = [r["v"] for r in rows]
    return {"values": values}


def encode(df, p, state):
    """One column per value (onehot), or the place of the value in sorted order (ordinal)."""
    for n, values in state["values"].items():
        c = F.col(rename_free(df, n))
        if p.get("method", "onehot") == "onehot":
            df = df.select("*", *[c.eqNullSafe(F.lit(v)).alias(f"{n}_{v}") for v in values]).drop(n)
        elif values:
            code = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
            df = df.withColumn(n, F.when(c.isNotNull(), F.try_element_at(code, c)))
    return df


def fit_scale(df, p):
    names, how = present(df, p["columns"]), p.get("method", "standard")
    state = {}
    for n, i in zip(names, range(len(names)), strict=True):
        del i
        c = F.col(rename_free(df, n)).cast("double")
        if how == "standard":
            row = df.agg(F.avg(c), F.stddev_samp(c)).first()
        elif how == "minmax":
            row = df.agg(F.min(c), F.max(c) - F.min(c)).first()
        else:
            q = df.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
            row = (q[1], q[2] - q[0]) if q else (None, None)
        if row[0] is not None:
            state[n] = [row[0], row[1] or 1.0]
    return {"scales": state}


def scale(df, p, state):
    for n, (centre, width) in state["scales"].items():
        df = df.withColumn(n, (F.col(rename_free(df, n)).cast("double") - F.lit(centre)) / F.lit(width))
    return df


def datepart(df, p, state=None):
    made = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday, "dayofyear": F.dayofyear, "quarter": F.quarter,
        "hour": F.hour, "week": F.weekofyear,
    }
    unknown = [x for x in p.get("parts", []) if x not in made]
    if unknown:
        raise ValueError(f"datepart: unknown {', '.join(map(str, unknown))}; known are {', '.join(made)}")
    kinds = dict(df.dtypes)
    for n in present(df, p["columns"]):
        c = F.col(rename_free(df, n))
        c = parsed_moment(c) if kinds[n] == "string" else c
        for part in p.get("parts", ["year", "month", "day", "dayofweek"]):
            df = df.withColumn(f"{n}_{part}", made[part](c))
    return df


def log(df, p, state=None):
    for n in present(df, p["columns"]):
        c = F.col(rename_free(df, n)).cast("double")
        new = F.signum(c) * F.log1p(F.abs(c)) if p.get("method", "log1p") == "signed" else F.when(c >= 0, F.log1p(c))
        df = df.withColumn(n, new)
    return df


def interact(df, p, state=None):
    for a, b in combinations(present(df, p["columns"]), 2):
        x, y = F.col(rename_free(df, a)), F.col(rename_free(df, b))
        if p.get("method", "product") == "product":
            df = df.withColumn(f"{a}_x_{b}", x * y)
        else:
            df = df.withColumn(f"{a}_over_{b}", F.try_divide(x.cast("double"), y.cast("double")))
    return df


def binarize(df, p, state=None):
    for n in present(df, p["columns"]):
        df = df.withColumn(n, (F.col(rename_free(df, n)) > F.lit(p.get("threshold", 0))).cast("double"))
    return df


def fit_bin(df, p):
    n_bins, names = p.get("bins", 5), present(df, p["columns"])
    if n_bins < 2:
        raise ValueError(f"bin: at least 2 bins are needed, not {n_bins}")
    edges = {}
    for n in names:
        c = F.col(rename_free(df, n)).cast("double")
        if p.get("method", "quantile") == "quantile":
            found = df.agg(F.percentile(c, F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)]))).first()[0]
            found = sorted(set(found or []))
        else:
            lo, hi = df.agg(F.min(c), F.max(c)).first()
            found = [] if lo is None or lo == hi else [lo + (hi - lo) * i / n_bins for i in range(n_bins + 1)]
        if len(found) > 2 or (len(found) == 2 and p.get("method", "quantile") == "quantile"):
            edges[n] = found
    return {"edges": edges}


def bin(df, p, state):  # noqa: A001
    """Number of inner edges below the value: bins are closed on the right, the first one on both sides."""
    for n, edges in state["edges"].items():
        c = F.col(rename_free(df, n)).cast("double")
        code = F.lit(0)
        for e in edges[1:-1]:
            code = code + (c > F.lit(e)).cast("int")
        df = df.withColumn(n, F.when(c.isNotNull(), code))
    return df


def hash_fold(key, folds, seed):
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long"), F.lit(folds))


def numeric_target(df, target, codes):
    if codes is None:
        return F.col(rename_free(df, target)).cast("double")
    return F.try_element_at(F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(rename_free(df, target)).cast("string"))


def fit_target_encode(df, p):
    """Codes of a non-numeric target, the prior, and the table of sums (a DataFrame: it may be as wide as the data)."""
    target, names = p["target"], [n for n in present(df, p["columns"]) if n != p["target"]]
    kind = dict(df.dtypes)[target]
    codes = None
    if kind in ("string", "boolean"):
        values = [r[0] for r in df.where(F.col(rename_free(df, target)).isNotNull()).select(F.col(rename_free(df, target)).cast("string")).distinct().orderBy(1).limit(1001).collect()]
        if len(values) > 1000:
            raise ValueError(f"target-encode: {target} has more than 1000 classes")
        codes = {v: i for i, v in enumerate(values)}
    y = numeric_target(df, target, codes)
    prior = df.agg(F.avg(y)).first()[0]
    sums = {n: df.groupBy(F.col(rename_free(df, n)).alias("v")).agg(F.sum(y).alias("s"), F.count(y).alias("n")) for n in names}
    return {"codes": codes, "prior": prior, "sums": sums}


def target_encode(df, p, state):
    """Smoothed means of the target by category from all fitted rows; an unseen category gets the prior."""
    smooth, prior = float(p.get("smoothing", 20)), state["prior"]
    for n, sums in state["sums"].items():
        table = sums.select(F.col("v").alias("_v"), ((F.col("s") + smooth * prior) / (F.col("n") + smooth)).alias("_m"))
        df = df.join(table, F.col(rename_free(df, n)).eqNullSafe(F.col("_v")), "left").withColumn(n, F.coalesce("_m", F.lit(prior))).drop("_v", "_m")
    return df


def target_encode_oof(df, p, state=None):
    """Out of fold: a row's category mean leaves out its own fold; folds are a hash of ``key`` and ``seed``."""
    target, smooth, folds = p["target"], float(p.get("smoothing", 20)), p.get("folds", 5)
    key = [F.col(rename_free(df, c)) for c in p.get("key") or df.columns]
    codes = fit_target_encode(df, {"target": target, "columns": []})["codes"]
    df = df.withColumn("_fold", hash_fold(key, folds, p.get("seed", 0))).withColumn("_y", numeric_target(df, target, codes))
    by_fold = df.groupBy("_fold").agg(F.sum("_y").alias("fs"), F.count("_y").alias("fn"))
    total = Window.partitionBy()
    prior = by_fold.select("_fold", F.try_divide(F.sum("fs").over(total) - F.col("fs"), F.sum("fn").over(total) - F.col("fn")).alias("_prior"))
    for n in [c for c in present(df, p["columns"]) if c != target]:
        part = df.groupBy(F.col(rename_free(df, n)).alias("_v"), "_fold").agg(F.sum("_y").alias("s"), F.count("_y").alias("n"))
        whole = Window.partitionBy("_v")
        table = part.select(
            "_v", F.col("_fold").alias("_f"), (F.coalesce(F.sum("s").over(whole), F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("_s"),
            (F.sum("n").over(whole) - F.col("n")).alias("_n"),
        )
        joined = df.join(table, F.col(rename_free(df, n)).eqNullSafe(F.col("_v")) & (F.col("_fold") == F.col("_f")), "left").join(F.broadcast(prior), "_fold", "left")
        df = joined.withColumn(n, (F.col("_s") + smooth * F.col("_prior")) / (F.col("_n") + smooth)).drop("_v", "_f", "_s", "_n", "_prior")
    return df.drop("_fold", "_y")


def text_length(df, p, state=None):
    for n in present(df, p["columns"]):
        c = F.col(rename_free(df, n))
        df = df.withColumn(f"{n}_chars", F.length(c)).withColumn(f"{n}_words", F.when(c.isNotNull(), F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))))
    return df


def terms_of(c, ngrams):
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    out = words
    for n in range(2, ngrams + 1):
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i, n=n: F.array_join(F.slice(words, i, n), " "))
        out = F.concat(out, F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>")))
    return out


def fit_tfidf(df, p):
    """The most frequent terms with their smoothed inverse document frequencies, by name."""
    n, ngrams = p["column"], p.get("ngrams", 1)
    terms = df.select(F.monotonically_increasing_id().alias("d"), F.coalesce(terms_of(F.col(rename_free(df, n)), ngrams), F.array().cast("array<string>")).alias("t"))
    docs = df.count()
    counts = terms.select(F.explode("t").alias("term"), "d").groupBy("term", "d").agg(F.count(F.lit(1)).alias("c")).groupBy("term").agg(F.sum("c").alias("tf"), F.count(F.lit(1)).alias("df"))
    top = counts.orderBy(F.desc("tf"), "term").limit(p.get("max_features", 50)).withColumn("idf", F.log((1.0 + docs) / (1.0 + F.col("df"))) + 1.0)
    return {"idf": {r["term"]: r["idf"] for r in top.orderBy("term").collect()}}


def tfidf(df, p, state):
    n, idf = p["column"], state["idf"]
    if not idf:
        return df
    df = df.withColumn("_terms", F.filter(terms_of(F.coalesce(F.col(rename_free(df, n)), F.lit("")), p.get("ngrams", 1)), lambda t: t.isin(*idf)))
    raw = [(F.size("_terms") - F.size(F.array_remove("_terms", t))) * F.lit(w) for t, w in idf.items()]
    df = df.withColumn("_raw", F.array(*raw)).withColumn("_norm", F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x * x)))
    made = [F.when(F.col("_norm") > 0, F.col("_raw")[i] / F.col("_norm")).otherwise(0.0).alias(f"{n}_tf_{t}") for i, t in enumerate(idf)]
    return df.select("*", *made).drop(n, "_terms", "_raw", "_norm")


def over_all_rows(df, order, reach, value, name, buckets=32, within=()):
    """A window over the whole table, or over large groups, without one task: buckets by quantiles of the first order
    column, each with the last ``reach`` rows before it."""
    kind = df.select(order[0].alias("b")).dtypes[0][1]
    if kind == "string":  # six bytes as a number keep the order, from the first in which texts differ
        low, high = (x.encode() for x in df.agg(F.coalesce(F.min(order[0]), F.lit("")), F.coalesce(F.max(order[0]), F.lit(""))).first())
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        by = F.conv(F.rpad(F.hex(F.substring(F.encode(order[0], "utf-8"), same + 1, 6)), 12, "0"), 16, 10).cast("double")
    else:
        by = (order[0].cast("timestamp") if kind in ("timestamp_ntz", "date") else order[0]).cast("double")
    cuts = df.agg(F.percentile_approx(by, [i / buckets for i in range(1, buckets)], 1000)).first()[0] if buckets > 1 else None
    cuts = sorted(set(cuts or []))
    code = F.lit(0)
    for c in cuts:
        code = code + F.coalesce((by > F.lit(c)).cast("int"), F.lit(1))
    own = df.withColumn("_b", code).withColumn("_own", F.lit(True))
    back = Window.partitionBy(*within, "_b").orderBy(*[o.desc_nulls_first() for o in order])
    tails = own.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= reach)
    later = tails.select("*", F.explode(F.sequence(F.col("_b") + 1, F.greatest(F.col("_b") + 1, F.lit(len(cuts))))).alias("_to")).where(F.col("_to") <= len(cuts))
    nearest = Window.partitionBy(*within, "_to").orderBy(F.desc("_b"), F.asc("_r"))
    carried = later.withColumn("_k", F.row_number().over(nearest)).where(F.col("_k") <= reach)
    carried = carried.withColumn("_b", F.col("_to")).withColumn("_own", F.lit(False)).drop("_r", "_to", "_k")
    forward = Window.partitionBy(*within, "_b").orderBy(*[o.asc_nulls_last() for o in order])
    return own.unionByName(carried).withColumn(name, value(forward)).where("_own").drop("_b", "_own")


def ordered_window(df, p, reach, value, name, large=20_000_000):
    """The window in the order of ``by``, over the table or within groups; groups of over ``large`` rows are cut into buckets."""
    by, group = F.col(rename_free(df, p["by"])), p.get("group")
    order = [by, *row_order(df, p.get("key"))]
    if not group:
        return over_all_rows(df, order, reach, value, name)
    if group not in df.columns:
        raise ValueError(f"no column {group} to group by")
    g = F.col(rename_free(df, group))
    forward = Window.partitionBy(g).orderBy(*[o.asc_nulls_last() for o in order])
    # at most one group for every ``large`` rows
    hot = [r[0] for r in df.where(g.isNotNull()).groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).collect()]
    is_hot = F.coalesce(g.isin(hot), F.lit(False))
    plain = (df.where(~is_hot) if hot else df).withColumn(name, F.when(g.isNotNull(), value(forward)))
    return plain.unionByName(over_all_rows(df.where(is_hot), order, reach, value, name, within=(g,))) if hot else plain


def lag(df, p, state=None):
    n = p.get("periods", 1)
    if n < 1:
        raise ValueError(f"lag: periods must be positive, not {n}")
    for c in present(df, p["columns"]):
        df = ordered_window(df, p, n, lambda w, c=c: F.lag(F.col(rename_free(df, c)), n).over(w), f"{c}_lag{n}")
    return df


def rolling(df, p, state=None):
    size, stat, least = p.get("window", 3), p.get("stat", "mean"), p.get("min_periods", 1)
    if size < 2:
        raise ValueError(f"rolling: the window must have 2 rows or more, not {size}")
    made = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}[stat]
    for c in present(df, p["columns"]):
        x = F.col(rename_free(df, c)).cast("double")

        def value(w, x=x):
            w = w.rowsBetween(1 - size, 0)
            return F.when(F.count(x).over(w) >= least, made(x).over(w))

        df = ordered_window(df, p, size - 1, value, f"{c}_roll{size}_{stat}")
    return df
