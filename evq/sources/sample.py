"""Domain views over the sample star schema, once as DataFrames and once as oracle SQL.

Orders play the event library, part types the industries, the weekly volume-weighted
line price the price panel, documents the corpus, benchmark items the search queries.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evq.functions.lineage import stage

P_STAR = 2147483647


def seeded_prob(event_id="event_id", code="industry_code", seed: int = 0):
    """A reproducible pseudo prediction in [0, 1): the same integer formula on both engines."""
    mixed = (F.col(event_id) * 7919 + (F.ascii(F.col(code)) * 31 + F.length(F.col(code)) * 17) * 104729
             + F.lit(seed * 15485863).cast("long"))
    return (mixed % 1000).cast("double") / 1000.0


def dec_sum(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


class Sample:
    """Lazy DataFrames over one folder of sample tables.

    The panel, index, scenario and label tables are written once per application and
    read by every query after that, as the stored tables they stand for would be.
    """

    _open: dict[tuple[str, str], "Sample"] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Sample":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir)
        return cls._open[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._read = spark, sf_dir, {}

    def t(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._read[name]

    @cached_property
    def px(self) -> DataFrame:
        li = self.t("lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
        pt = self.t("part").select("p_partkey", F.col("p_type").alias("industry_code"))
        return stage(
            li.join(pt, li.l_partkey == pt.p_partkey)
            .groupBy("industry_code", F.to_date(F.date_trunc("week", "l_shipdate")).alias("d"))
            .agg((dec_sum("l_extendedprice") / dec_sum("l_quantity")).alias("close"), dec_sum("l_quantity").alias("volume"),
                 (dec_sum("l_discount") / F.count("*")).alias("dividend_yield")), "px"
        )

    @cached_property
    def mkt(self) -> DataFrame:
        return stage(
            self.t("lineitem").groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("d"))
            .agg((dec_sum("l_extendedprice") / dec_sum("l_quantity")).alias("mkt_close")), "mkt"
        )

    @cached_property
    def val(self) -> DataFrame:
        w = Window.partitionBy("industry_code").orderBy("d").rowsBetween(-25, 0)
        return self.px.select(
            "industry_code", "d", (F.col("close") / F.avg("close").over(w)).alias("pe_ttm"),
            (F.col("close") / F.col("volume")).alias("pb"), "dividend_yield")

    @cached_property
    def margin(self) -> DataFrame:
        d = F.to_date(F.date_trunc("week", "l_shipdate")).alias("d")
        amount = F.col("l_tax").cast("decimal(18,2)") * F.col("l_extendedprice").cast("decimal(18,2)")
        return self.t("lineitem").groupBy(d).agg(F.sum(amount).cast("double").alias("total_fin"))

    @cached_property
    def rates(self) -> DataFrame:
        d = F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")
        return self.t("lineitem").groupBy(d).agg(
            (dec_sum("l_discount") / F.count("*")).alias("rate_1"), (dec_sum("l_tax") / F.count("*")).alias("rate_2"))

    @cached_property
    def ev(self) -> DataFrame:
        return self.t("orders").select(
            F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("event_date"),
            F.col("o_orderpriority").alias("event_type"),
            F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise("0").alias("direction"))

    @cached_property
    def scn(self) -> DataFrame:
        li = self.t("lineitem").select("l_orderkey", "l_partkey")
        pt = self.t("part").select("p_partkey", F.col("p_type").alias("industry_code"))
        pairs = li.join(pt, li.l_partkey == pt.p_partkey).select(
            F.col("l_orderkey").alias("event_id"), "industry_code").distinct()
        return stage(self.ev.join(pairs, "event_id"), "scn")

    @cached_property
    def docs(self) -> DataFrame:
        """Feed src0 carries no dates, src5 holds mechanism notes, src7 sets valid_from."""
        pub = F.expr("date_add(DATE '1995-01-01', CAST(doc_id * 37 % 2400 AS INT))")
        return self.t("documents").select(
            "doc_id", "text", "lang", "source",
            F.when(F.col("source") != "src0", pub).alias("pub_date"),
            F.when(F.col("source") == "src7", F.date_add(pub, -30)).alias("valid_from"),
            F.when(F.col("source") == "src5", "mechanism").otherwise("event").alias("doc_type"))

    @cached_property
    def qry(self) -> DataFrame:
        return self.t("benchmark").select(
            F.col("item_id").alias("query_id"), "text",
            F.expr("date_add(DATE '1998-01-01', CAST(item_id * 53 % 1000 AS INT))").alias("as_of"))

    @cached_property
    def car(self) -> DataFrame:
        from evq.operators.events import car_diff

        return stage(car_diff(self.scn, self.px, self.mkt, (1, 5, 20)), "car")

    def res(self, seed: int = 0) -> DataFrame:
        """Prediction rows: a seeded probability next to the realised five-step direction."""
        c = self.car.filter(F.col("window") == 5)
        p = seeded_prob(seed=seed)
        return c.select(
            "event_id", "event_date", "event_type", "industry_code", p.alias("prob_up"),
            F.when(F.col("car") >= 0, "+").otherwise("-").alias("real_dir"),
            F.when(p >= 0.5, "+").otherwise("-").alias("final_dir"), F.col("car"),
            (F.when(F.col("car") >= 0, "+").otherwise("-") == F.when(p >= 0.5, "+").otherwise("-")).alias("dir_correct"),
            (F.abs(p - 0.5) * 2).alias("confidence"), (F.abs(p - 0.5) < 0.12).alias("abstain"))

    @cached_property
    def feat(self) -> DataFrame:
        from evq.operators.features import features

        return features(self.px, self.mkt)

    @cached_property
    def fc(self) -> DataFrame:
        """Ten-step forecast paths per industry and day: half of the last ten returns,
        a fixed interval, and the returns that followed."""
        w = Window.partitionBy("industry_code").orderBy("d")
        rows = self.feat.filter("ret is not null").select(
            "industry_code", "d", F.collect_list("ret").over(w.rowsBetween(-10, -1)).alias("p"),
            F.collect_list("ret").over(w.rowsBetween(0, 9)).alias("a")).filter("size(p) = 10 and size(a) = 10")
        step = rows.select("industry_code", "d", F.posexplode(F.arrays_zip("p", "a")).alias("step", "x"))
        half = 0.2 + 0.02 * F.col("step")
        mean = F.col("x.p") * 0.5
        return step.select("industry_code", "d", "step", mean.alias("mean"), F.col("x.a").alias("actual"),
                           (mean - 0.65 * half).alias("lower_80"), (mean + 0.65 * half).alias("upper_80"),
                           (mean - half).alias("lower_95"), (mean + half).alias("upper_95"))

    @cached_property
    def real(self) -> DataFrame:
        """Realised active paths (six digits) of every industry and event date, at most three rows for each calendar day and industry."""
        from evq.functions.cols import r6
        from evq.functions.sizing import settled
        from evq.operators.events import realized_path

        dates = self.scn.select("industry_code", "event_date").distinct()
        return settled(realized_path(dates, self.px, self.mkt).select(
            "industry_code", F.col("event_date").alias("_on"), "horizon", *[r6(c).alias(c) for c in ("realized_car", "realized_mdd", "realized_downside")]))

    @cached_property
    def repeated(self) -> DataFrame:
        """(event_id, _at) of the events whose id comes more than once, one row for each of them."""
        from evq.functions.sizing import settled, small

        ids = small(stage(self.ev.groupBy("event_id").count().filter("count > 1").select("event_id"), "repeated"))
        return settled(self.ev.join(ids, "event_id", "left_semi").select("event_id", F.struct("event_date").alias("_at")))

    def dated(self, rows: DataFrame) -> DataFrame:
        """rows, once for every row of their event id, with that row's date as _on; without a shuffle where ids come once."""
        got = rows.join(self.repeated, "event_id", "left")
        return got.withColumn("_on", F.when(F.col("_at").isNull(), F.col("event_date")).otherwise(F.col("_at.event_date"))).drop("_at")

    def risk_rows(self, seed: int = 0, scales=None) -> DataFrame:
        """Scenario by horizon: predicted VaR next to the realised active path (six digits).

        The path hangs on industry and date alone, so scenarios look it up and are not shuffled. An event id
        that comes more than once meets the paths of all its rows.
        """
        from evq.functions.cols import r6
        from evq.operators.portfolio import vol_var

        pred = vol_var(self.res(seed), self.feat, **({"scales": scales} if scales else {}))
        keys = ["event_id", "industry_code", "horizon"]
        return self.dated(pred).join(self.real, ["industry_code", "horizon", "_on"]).select(
            *keys, *[c for c in pred.columns if c not in keys], "realized_car", "realized_mdd", "realized_downside").withColumns({
                "pred_var": r6("pred_var"), "pred_mdd": r6(-0.8 * F.col("pred_var"))})

    @cached_property
    def kg_nodes(self) -> DataFrame:
        def node(t, key, name, layer, rank):
            return self.t(t).select(F.concat(F.lit(layer[0] + ":"), F.col(key)).alias("node"), F.col(name).alias("name"),
                                    F.lit(layer).alias("layer"), F.lit(rank).alias("rank"))
        return (node("region", "r_regionkey", "r_name", "social", 0).unionByName(node("nation", "n_nationkey", "n_name", "industry", 1))
                .unionByName(node("supplier", "s_suppkey", "s_name", "company", 2))
                .unionByName(node("part", "p_partkey", "p_name", "asset", 3)))

    @cached_property
    def kg_edges(self) -> DataFrame:
        """region -> nation -> supplier -> part; part edges carry the last shipping day."""
        ends = self.t("lineitem").groupBy("l_suppkey", "l_partkey").agg(
            F.count("*").alias("n"), F.to_date(F.max("l_shipdate")).alias("created_at"))
        a = self.t("nation").select(F.concat(F.lit("s:"), "n_regionkey").alias("src"), F.concat(F.lit("i:"), "n_nationkey").alias("dst"),
                                    F.lit("hosts").alias("relation"), F.lit(0.8).alias("weight"), F.lit(0.9).alias("confidence"),
                                    F.lit(None).cast("date").alias("created_at"), F.lit(None).cast("double").alias("ttl_days"))
        b = self.t("supplier").select(F.concat(F.lit("i:"), "s_nationkey").alias("src"), F.concat(F.lit("c:"), "s_suppkey").alias("dst"),
                                      F.lit("has").alias("relation"), F.lit(0.9).alias("weight"), F.lit(0.8).alias("confidence"),
                                      F.lit(None).cast("date").alias("created_at"), F.lit(None).cast("double").alias("ttl_days"))
        c = ends.select(F.concat(F.lit("c:"), "l_suppkey").alias("src"), F.concat(F.lit("a:"), "l_partkey").alias("dst"),
                        F.lit("supplies").alias("relation"), F.least(F.lit(1.0), F.col("n") / 2.0).alias("weight"),
                        F.lit(0.7).alias("confidence"), "created_at", F.lit(365.0).alias("ttl_days"))
        return a.unionByName(b).unionByName(c)

    @cached_property
    def ticks_src(self) -> DataFrame:
        return self.t("events").select(F.col("ts"), F.col("event_type").alias("industry_code"), F.col("value"), F.col("event_id"))


VIEWS: dict[str, str] = {
    "px": """SELECT p_type AS industry_code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
        CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS dividend_yield
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "mkt": """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS d,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS mkt_close
        FROM lineitem GROUP BY 1""",
    "val": """SELECT industry_code, d, close / avg(close) OVER (PARTITION BY industry_code ORDER BY d ROWS 25 PRECEDING) AS pe_ttm,
        close / volume AS pb, dividend_yield FROM px""",
    "margin": """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS d,
        CAST(sum(CAST(l_tax AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_fin FROM lineitem GROUP BY 1""",
    "rates": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
        CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS rate_1,
        CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS rate_2 FROM lineitem GROUP BY 1""",
    "ev": """SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_date, o_orderpriority AS event_type,
        CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '0' END AS direction FROM orders""",
    "scn": """SELECT DISTINCT event_id, event_date, event_type, direction, p_type AS industry_code
        FROM ev JOIN lineitem ON l_orderkey = event_id JOIN part ON l_partkey = p_partkey""",
    "docs": """SELECT doc_id, text, lang, source,
        CASE WHEN source <> 'src0' THEN DATE '1995-01-01' + CAST(doc_id * 37 % 2400 AS INT) END AS pub_date,
        CASE WHEN source = 'src7' THEN DATE '1995-01-01' + CAST(doc_id * 37 % 2400 AS INT) - 30 END AS valid_from,
        CASE WHEN source = 'src5' THEN 'mechanism' ELSE 'event' END AS doc_type FROM documents""",
    "qry": """SELECT item_id AS query_id, text, DATE '1998-01-01' + CAST(item_id * 53 % 1000 AS INT) AS as_of FROM benchmark""",
    # derived views shared by several oracles
    "cal": """SELECT d, row_number() OVER (ORDER BY d) - 1 AS day_idx FROM (SELECT d FROM px INTERSECT SELECT d FROM mkt)""",
    "dense": """SELECT i.industry_code, c.d, c.day_idx, p.close, p.volume, m.mkt_close
        FROM (SELECT DISTINCT industry_code FROM px) i CROSS JOIN cal c
        LEFT JOIN px p ON p.industry_code = i.industry_code AND p.d = c.d JOIN mkt m ON m.d = c.d""",
    "ret": """SELECT industry_code, d, day_idx,
        close / lag(close) OVER (PARTITION BY industry_code ORDER BY d) - 1 AS r,
        mkt_close / lag(mkt_close) OVER (PARTITION BY industry_code ORDER BY d) - 1 AS m FROM dense""",
    "probe": """SELECT DISTINCT industry_code, event_date FROM scn""",
    "anch": """SELECT event_date, min(d) AS t0, min(day_idx) AS t0_idx
        FROM (SELECT DISTINCT event_date FROM ev) e JOIN cal ON d >= event_date GROUP BY 1""",
    "car0": """SELECT industry_code, event_date, t0, w AS "window",
        exp(sum(ln(1 + coalesce(r, 0)))) - 1 AS cum_ind_ret, exp(sum(ln(1 + coalesce(m, 0)))) - 1 AS cum_mkt_ret
        FROM probe JOIN anch USING (event_date) CROSS JOIN (VALUES (1), (5), (20)) g(w)
        JOIN ret USING (industry_code) WHERE day_idx BETWEEN t0_idx AND t0_idx + w GROUP BY 1, 2, 3, 4 HAVING count(*) = w + 1""",
    "car": """SELECT event_id, event_date, event_type, direction, industry_code, "window", t0,
        round(cum_ind_ret, 6) + 0.0::DOUBLE AS cum_ind_ret, round(cum_mkt_ret, 6) + 0.0::DOUBLE AS cum_mkt_ret,
        round(cum_ind_ret - cum_mkt_ret, 6) + 0.0::DOUBLE AS car FROM scn JOIN car0 USING (industry_code, event_date)""",
    "feat": """SELECT *, CASE WHEN count(ret) OVER w5 = 5 THEN stddev_samp(ret) OVER w5 END AS volatility,
        CASE WHEN count(close) OVER w5 = 5 THEN avg(close) OVER w5 / close - 1 END AS ma5_gap,
        CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 / close - 1 END AS ma20_gap
        FROM (SELECT industry_code, d, close, volume, mkt_close, close / lag(close) OVER o - 1 AS ret,
              volume / lag(volume) OVER o - 1 AS vol_chg, mkt_close / lag(mkt_close) OVER o - 1 AS mkt_ret
              FROM px LEFT JOIN mkt USING (d) WINDOW o AS (PARTITION BY industry_code ORDER BY d))
        WINDOW w5 AS (PARTITION BY industry_code ORDER BY d ROWS 4 PRECEDING), w20 AS (PARTITION BY industry_code ORDER BY d ROWS 19 PRECEDING)""",
    "fc": """SELECT a.industry_code, a.d, CAST(b.k - a.k + 10 AS INT) AS step, b.ret * 0.5::DOUBLE AS mean, c.ret AS actual,
        b.ret * 0.5::DOUBLE - 0.65::DOUBLE * (0.2::DOUBLE + 0.02::DOUBLE * (b.k - a.k + 10)) AS lower_80, b.ret * 0.5::DOUBLE + 0.65::DOUBLE * (0.2::DOUBLE + 0.02::DOUBLE * (b.k - a.k + 10)) AS upper_80,
        b.ret * 0.5::DOUBLE - (0.2::DOUBLE + 0.02::DOUBLE * (b.k - a.k + 10)) AS lower_95, b.ret * 0.5::DOUBLE + (0.2::DOUBLE + 0.02::DOUBLE * (b.k - a.k + 10)) AS upper_95
        FROM fnum a JOIN fnum b ON b.industry_code = a.industry_code AND b.k BETWEEN a.k - 10 AND a.k - 1
        JOIN fnum c ON c.industry_code = a.industry_code AND c.k = b.k + 10 WHERE a.k >= 10 AND a.k + 9 <= a.n - 1""",
    "fnum": """SELECT industry_code, d, ret, row_number() OVER (PARTITION BY industry_code ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY industry_code) AS n
        FROM feat WHERE ret IS NOT NULL""",
    "rp0": """SELECT industry_code, event_date, t0, h, day_idx, sum(ln((1 + coalesce(r, 0)) / (1 + coalesce(m, 0)))) OVER w AS lg
        FROM probe JOIN anch USING (event_date) CROSS JOIN (VALUES (1), (5), (20)) g(h) JOIN ret USING (industry_code)
        WHERE day_idx BETWEEN t0_idx AND t0_idx + h WINDOW w AS (PARTITION BY industry_code, event_date, h ORDER BY day_idx)""",
    "rp": """SELECT industry_code, event_date, t0, h AS horizon, r6(exp(arg_max(lg, day_idx)) - 1) AS realized_car, r6(max((peak - exp(lg)) / peak)) AS realized_mdd,
        r6(greatest(1 - exp(arg_max(lg, day_idx)), 0)) AS realized_downside FROM (
        SELECT *, greatest(1.0, max(exp(lg)) OVER (PARTITION BY industry_code, event_date, h ORDER BY day_idx)) AS peak FROM rp0) GROUP BY 1, 2, 3, 4 HAVING count(*) = h + 1""",
    "sig": """SELECT industry_code, event_date, stddev_pop(ret) AS sigma FROM (SELECT industry_code, event_date, ret FROM probe JOIN feat USING (industry_code)
        WHERE d < event_date AND ret IS NOT NULL AND vol_chg IS NOT NULL AND volatility IS NOT NULL AND mkt_ret IS NOT NULL AND ma5_gap IS NOT NULL AND ma20_gap IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY industry_code, event_date ORDER BY d DESC) <= 120) GROUP BY 1, 2""",
    "kg_edges": """SELECT 's:' || n_regionkey AS src, 'i:' || n_nationkey AS dst, 'hosts' AS relation, 0.8::DOUBLE AS weight, 0.9::DOUBLE AS confidence,
          NULL::DATE AS created_at, NULL::DOUBLE AS ttl_days FROM nation
        UNION ALL SELECT 'i:' || s_nationkey, 'c:' || s_suppkey, 'has', 0.9, 0.8, NULL, NULL FROM supplier
        UNION ALL SELECT 'c:' || l_suppkey, 'a:' || l_partkey, 'supplies', least(1.0::DOUBLE, count(*) / 2.0::DOUBLE), 0.7, CAST(max(l_shipdate) AS DATE), 365.0
          FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "kg_nodes": """SELECT 's:' || r_regionkey AS node, r_name AS name, 'social' AS layer, 0 AS rank FROM region
        UNION ALL SELECT 'i:' || n_nationkey, n_name, 'industry', 1 FROM nation
        UNION ALL SELECT 'c:' || s_suppkey, s_name, 'company', 2 FROM supplier
        UNION ALL SELECT 'a:' || p_partkey, p_name, 'asset', 3 FROM part""",
}
for _s in range(4):
    VIEWS[f"res{_s}"] = f"""SELECT *, real_dir = final_dir AS dir_correct, abs(prob_up - 0.5::DOUBLE) * 2 AS confidence,
        abs(prob_up - 0.5::DOUBLE) < 0.12::DOUBLE AS abstain FROM (
        SELECT *, CASE WHEN prob_up >= 0.5 THEN '+' ELSE '-' END AS final_dir FROM (
        SELECT event_id, event_date, event_type, industry_code, car, CASE WHEN car >= 0 THEN '+' ELSE '-' END AS real_dir,
        CAST((event_id * 7919 + (ascii(industry_code) * 31 + length(industry_code) * 17) * 104729 + {_s * 15485863}) % 1000 AS DOUBLE) / 1000 AS prob_up
        FROM car WHERE "window" = 5))"""


for _s in range(4):
    for _tag, _sc in (("rr", (0.4, -0.4, -0.4)), ("rw", (1.4, 0.6, 0.6))):
        VIEWS[f"{_tag}{_s}"] = f"""SELECT *, r6(-0.8::DOUBLE * pred_var) AS pred_mdd FROM (
        SELECT event_id, event_date, event_type, industry_code, horizon, prob_up, confidence, abstain, dir_correct, real_dir, realized_car, realized_mdd, realized_downside,
        r6(-1.645::DOUBLE * coalesce(sigma, 0.01) * sqrt(horizon) * (1 + sc * greatest(0, 1 - confidence))) AS pred_var,
        1.15::DOUBLE * (-1.645::DOUBLE * coalesce(sigma, 0.01) * sqrt(horizon) * (1 + sc * greatest(0, 1 - confidence))) AS pred_es
        FROM res{_s} LEFT JOIN sig USING (industry_code, event_date) JOIN rp USING (industry_code, event_date)
        JOIN (VALUES (1, {_sc[0]}::DOUBLE), (5, {_sc[1]}::DOUBLE), (20, {_sc[2]}::DOUBLE)) g(horizon, sc) USING (horizon))"""


def _macro(sql: str, name: str, digits: int) -> str:
    """Expand name(expr) innermost last; -0.0 becomes 0.0 as in the Spark helper."""
    mark = re.compile(rf"\b{name}\(")
    while m := mark.search(sql):
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        sql = f"{sql[:m.start()]}(round(CAST({sql[m.end():j - 1]} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)){sql[j:]}"
    return sql


def with_views(sql: str) -> str:
    """Prefix an oracle with the views it names, and expand r6(x) / r4(x) to a rounding."""
    body = sql.strip().rstrip(";")
    order: list[str] = []

    def walk(text: str) -> None:
        for v in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)\b", text):
            if v in VIEWS and v not in order:
                walk(VIEWS[v])
                order.append(v)

    walk(body)
    if order:
        ctes = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order)
        head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
        body = f"WITH {head.group(1) or ''}{ctes}, {body[head.end():]}" if head else f"WITH {ctes} {body}"
    for name, digits in (("r6", 6), ("r4", 4)):
        body = _macro(body, name, digits)
    return body
