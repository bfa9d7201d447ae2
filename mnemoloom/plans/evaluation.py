"""Evaluation metrics: success at budget, comparison, coverage, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.plans.base import query

C, L = F.col, F.lit

_RUN = "SELECT doc_id AS id, quality AS pass, toxic AS hard, doc_id % 700 AS ctx, (doc_id % 97) / 97.0::DOUBLE AS score FROM {labels}"


def run_rows(t):
    return t("labels").select(C("doc_id").alias("id"), C("quality").alias("pass"), C("toxic").alias("hard"), (C("doc_id") % 700).alias("ctx"), (C("doc_id") % 97 / 97.0).alias("score"))


@query("a11_median_mad", f"WITH r AS ({_RUN}), m AS (SELECT hard, quantile_cont(score, 0.5) AS med FROM r GROUP BY 1) SELECT r.hard, round(med, 6) AS med, round(quantile_cont(abs(score - med), 0.5), 6) AS mad FROM r JOIN m ON m.hard = r.hard GROUP BY r.hard, med")
def _(t):
    r = run_rows(t)
    j = r.join(r.groupBy("hard").agg(F.percentile("score", 0.5).alias("med")), "hard")
    return j.groupBy("hard", "med").agg(F.round(F.percentile(F.abs(C("score") - C("med")), 0.5), 6).alias("mad")).select("hard", F.round("med", 6).alias("med"), "mad")


@query("a12_success_at_budget", f"SELECT round(avg(pass), 6) AS sr, round(avg(CASE WHEN hard = 1 THEN pass END), 6) AS tail, round(avg(ctx), 4) AS mean_ctx, count(*) AS n FROM ({_RUN})")
def _(t):
    return run_rows(t).agg(F.round(F.avg("pass"), 6).alias("sr"), F.round(F.avg(F.when(C("hard") == 1, C("pass"))), 6).alias("tail"), F.round(F.avg("ctx"), 4).alias("mean_ctx"), F.count(L(1)).alias("n"))


@query("a13_compare_runs", f"""WITH b AS ({_RUN}), a AS (SELECT id, CASE WHEN id % 11 = 0 THEN 1 - pass ELSE pass END AS pass FROM b WHERE id % 13 <> 0)
    SELECT count(*) AS n, round(avg(a.pass) - avg(b.pass), 6) AS delta, count(*) FILTER (WHERE b.pass = 1 AND a.pass = 0) AS regressions, count(*) FILTER (WHERE b.pass = 0 AND a.pass = 1) AS gains,
    round(count(*) FILTER (WHERE b.pass = 1 AND a.pass = 0) / sum(b.pass), 6) AS forgetting FROM b JOIN a ON a.id = b.id""")  # fmt: skip
def _(t):
    before = run_rows(t).select("id", C("pass").alias("b"))
    after = before.where("id % 13 <> 0").select("id", F.when(C("id") % 11 == 0, 1 - C("b")).otherwise(C("b")).alias("a"))
    lost = F.count_if((C("b") == 1) & (C("a") == 0))
    return before.join(after, "id").agg(
        F.count(L(1)).alias("n"), F.round(F.avg("a") - F.avg("b"), 6).alias("delta"), lost.alias("regressions"), F.count_if((C("b") == 0) & (C("a") == 1)).alias("gains"), F.round(lost / F.sum("b"), 6).alias("forgetting")
    )


@query("a14_coverage", f"SELECT id % 50 AS q, bool_and(score >= 0.54) AS covered, count(*) AS facts FROM ({_RUN}) GROUP BY 1")
def _(t):
    return run_rows(t).groupBy((C("id") % 50).alias("q")).agg(F.bool_and(C("score") >= 0.54).alias("covered"), F.count(L(1)).alias("facts"))


@query("a15_tau_sweep", f"""WITH r AS ({_RUN}), tau AS (SELECT unnest(range(30, 81, 2)) AS k), c AS (SELECT k, count(*) FILTER (WHERE score * 100 >= k AND pass = 1) AS tp, count(*) FILTER (WHERE score * 100 < k AND pass = 0) AS tn,
    count(*) FILTER (WHERE score * 100 >= k AND pass = 0) AS fp, count(*) FILTER (WHERE score * 100 < k AND pass = 1) AS fn FROM r CROSS JOIN tau GROUP BY 1),
    b AS (SELECT *, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS bal FROM c)
    SELECT k, tp, tn, fp, fn, round(bal, 6) AS balanced, k = (SELECT k FROM b ORDER BY round(bal, 9) DESC, k LIMIT 1) AS best FROM b""")  # fmt: skip
def _(t):
    """One pass over the scores: a fixed list of thresholds is exploded beside each row's counts by score."""
    from pyspark.sql import Window

    r = run_rows(t).groupBy((C("score") * 100).alias("s"), "pass").agg(F.count(L(1)).alias("n"))
    x = r.withColumn("k", F.explode(F.sequence(L(30), L(80), L(2))))
    total = lambda over, good: F.sum(F.when((C("s") >= C("k")) == L(over), F.when(C("pass") == good, C("n")).otherwise(0)).otherwise(0))
    c = x.groupBy(C("k").cast("long").alias("k")).agg(total(True, 1).alias("tp"), total(False, 0).alias("tn"), total(True, 0).alias("fp"), total(False, 1).alias("fn"))
    b = c.withColumn("bal", (C("tp") / (C("tp") + C("fn")) + C("tn") / (C("tn") + C("fp"))) / 2)
    w = Window.orderBy(F.desc(F.round("bal", 9)), "k")  # as many rows as thresholds
    return b.withColumn("rn", F.row_number().over(w)).select("k", "tp", "tn", "fp", "fn", F.round("bal", 6).alias("balanced"), (C("rn") == 1).alias("best"))


@query("a16_pick_best", f"""SELECT cell, sr, tail, ctx FROM (SELECT id % 9 AS cell, round(avg(pass), 6) AS sr, round(coalesce(avg(CASE WHEN hard = 1 THEN pass END), 0), 6) AS tail, round(avg(ctx), 4) AS ctx FROM ({_RUN}) GROUP BY 1) ORDER BY sr DESC, tail DESC, ctx, cell LIMIT 1""")
def _(t):
    g = run_rows(t).groupBy((C("id") % 9).alias("cell")).agg(F.round(F.avg("pass"), 6).alias("sr"), F.round(F.coalesce(F.avg(F.when(C("hard") == 1, C("pass"))), L(0.0)), 6).alias("tail"), F.round(F.avg("ctx"), 4).alias("ctx"))
    return g.orderBy(F.desc("sr"), F.desc("tail"), "ctx", "cell").limit(1)


@query("a17_compression", """SELECT episode_id, round(octet_length(encode(substring(raw_text, 1, 120))) / octet_length(encode(raw_text)), 3) AS ratio FROM {episodes} WHERE raw_text <> ''""")
def _(t):
    """Bytes of the structure over bytes of the raw text."""
    e = t("episodes").where("raw_text <> ''")
    return e.select("episode_id", F.round(F.octet_length(F.substring("raw_text", 1, 120)) / F.octet_length("raw_text"), 3).alias("ratio"))


@query("sc12_gold_lines", """SELECT item_id, length(text) AS n FROM {benchmark}""")
def _(t):
    """JSON lines with comments: written as text, parsed with a schema."""
    lines = t("benchmark").select(F.to_json(F.struct(C("item_id"), C("text").alias("query"))).alias("value"))
    both = lines.unionByName(t("benchmark").limit(3).select(L("# comment").alias("value")))
    from mnemoloom.sources.gold import parse

    return parse(both, "item_id long, query string", ["query"]).select("item_id", F.length("query").cast("long").alias("n"))


@query("h16_labelled_pairs", f"SELECT id, pass, score FROM ({_RUN}) WHERE id % 5 <> 0")
def _(t):
    """Scores zipped with labels; runs of unequal length are skipped."""
    r = run_rows(t).select("id", F.array("score").alias("s"), F.when(C("id") % 5 == 0, F.array("pass", "pass")).otherwise(F.array("pass")).alias("l"))
    z = r.where(F.size("s") == F.size("l")).select("id", F.explode(F.arrays_zip("s", "l")).alias("z"))
    return z.select("id", C("z.l").alias("pass"), C("z.s").alias("score"))


@query("h17_cell_keys", f"SELECT concat_ws('/', concat('f', id % 3), 2000, id) AS cell FROM ({_RUN})")
def _(t):
    return run_rows(t).select(F.concat_ws("/", F.concat(L("f"), C("id") % 3), L(2000), C("id")).alias("cell"))


@query("x05_note_ranks", """SELECT probe, episode_id, rn FROM (SELECT p.claim_id AS probe, f.episode_id, row_number() OVER (PARTITION BY p.claim_id ORDER BY round(max(list_dot_product(cast(p.embedding AS DOUBLE[]), cast(f.embedding AS DOUBLE[]))), 9) DESC, f.episode_id) AS rn
    FROM {claims} p JOIN {fragments} f ON f.user_id = p.user_id WHERE p.vec_id % 20 = 0 GROUP BY 1, 2)""")  # fmt: skip
def _(t):
    """The rank of every note for every twentieth claim."""
    from pyspark.sql import Window

    from mnemoloom.operators import knn

    p = t("claims").where("vec_id % 20 = 0").select("user_id", C("claim_id").alias("probe"), "embedding")
    best = knn.greatest(p, t("fragments"), "probe", "frag_id", "episode_id").select("probe", C("tag").alias("episode_id"), C("sim").alias("s"))
    every = p.select("user_id", "probe").join(t("fragments").select("user_id", "episode_id").distinct(), "user_id").select("probe", "episode_id")
    s = every.join(best, ["probe", "episode_id"], "left")  # notes and claims without a vector come last
    return s.select("probe", "episode_id", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc(F.round("s", 9)), "episode_id")).cast("long").alias("rn"))


@query("x06_system_matrix", f"SELECT id % 3 AS system, id % 4 AS gold, round(avg(pass), 6) AS sr FROM ({_RUN}) GROUP BY 1, 2")
def _(t):
    return run_rows(t).groupBy((C("id") % 3).alias("system"), (C("id") % 4).alias("gold")).agg(F.round(F.avg("pass"), 6).alias("sr"))
