"""AML typologies, watchlist screening, cases, reports, feedback and the compliance pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.config import Aml, Sar
from fraudloom.functions import scalars as S
from fraudloom.functions.udfs import jaro_winkler_udf
from fraudloom.operators.names import similar_names
from fraudloom.operators.ranges import number
from fraudloom.scratch import Scratch

SCREEN_THRESHOLD = 0.88
STRONG_THRESHOLD = 0.95
BROADCAST_BYTES = 128 * 2**20


def structuring(tx: DataFrame, c: Aml = Aml()) -> DataFrame:
    """Accounts with enough credits just below the reporting threshold."""
    near = (F.col("direction") == "in") & (F.col("amount_minor") >= c.ctr_threshold_minor - c.structuring_band_minor) & (F.col("amount_minor") < c.ctr_threshold_minor)
    return tx.filter(near).groupBy("acct").agg(F.count("*").alias("n_deposits")).filter(F.col("n_deposits") >= c.structuring_min_count)


def funnel(tx: DataFrame, c: Aml = Aml()) -> DataFrame:
    """Accounts credited from many places that pay out to few counterparties."""
    place = F.when(F.col("direction") == "in", F.col("geography").cast("string")).when(F.col("direction") == "out", F.col("counterparty").cast("string"))
    # A transaction has a place of one kind, so it is one row here; two distinct counts beside each other would make two of it.
    places = tx.select("acct", "direction", place.alias("place")).filter("place is not null").distinct()
    g = places.groupBy("acct").agg(F.count_if(F.col("direction") == "in").alias("n_geographies"), F.count_if(F.col("direction") == "out").alias("n_destinations"))
    return g.filter((F.col("n_geographies") >= c.funnel_min_geographies) & F.col("n_destinations").between(1, c.funnel_max_destinations))


def round_trips(tx: DataFrame, c: Aml = Aml()) -> DataFrame:
    """Per account the first debit that some credit nearly equals within the window, before or after it.

    The band join runs on (account, time bin): a bin is as long as the window
    to both sides of a debit, so a debit looks into two bins, and busy
    accounts are cut into short ranges instead of pairing everything.
    """
    wide = c.round_trip_window_secs * 1_000_000 + 999_999
    bin_ = lambda us: F.expr(f"({us} - pmod({us}, {2 * wide})) div {2 * wide}")  # noqa: E731  whole numbers, exact
    out = tx.filter("direction = 'out'").select("acct", "seq", F.col("us").alias("out_us"), F.col("amount_minor").alias("out_minor"), F.explode(F.array(bin_(f"(us - {wide})"), bin_(f"(us + {wide})"))).alias("bin"))
    credit = tx.filter("direction = 'in'").select("acct", F.col("us").alias("in_us"), F.col("amount_minor").alias("in_minor"), bin_("us").alias("bin"))
    near = (F.floor(F.abs(F.col("in_us") - F.col("out_us")) / 1_000_000) <= c.round_trip_window_secs) & (F.abs(F.col("in_minor").cast("decimal(20,0)") - F.col("out_minor")).cast("double") <= c.round_trip_tolerance * F.col("out_minor"))
    hit = out.join(credit, (out.acct == credit.acct) & (out.bin == credit.bin) & near, "left_semi")
    return hit.groupBy("acct").agg(F.min_by("out_minor", "seq").alias("out_minor"), F.min("seq").alias("out_seq"))


def aml_alerts(tx: DataFrame, c: Aml = Aml()) -> DataFrame:
    """(acct, ord, typology, detail): structuring, funnel, round_tripping in that order."""
    a = structuring(tx, c).select("acct", F.lit(0).alias("ord"), F.lit("structuring").alias("typology"), F.format_string("%d deposits just below the CTR threshold", "n_deposits").alias("detail"))
    b = funnel(tx, c).select("acct", F.lit(1).alias("ord"), F.lit("funnel").alias("typology"), F.format_string("credits from %d geographies, debits to %d destinations", "n_geographies", "n_destinations").alias("detail"))
    r = round_trips(tx, c).select("acct", F.lit(2).alias("ord"), F.lit("round_tripping").alias("typology"), F.format_string("outbound %d matched by a near-equal inbound", "out_minor").alias("detail"))
    return a.unionByName(b).unionByName(r)


def screen(subjects: DataFrame, watchlist: DataFrame, threshold: float = SCREEN_THRESHOLD, strong: float = STRONG_THRESHOLD) -> DataFrame:
    """Alerts (subject_id, entry_id, matched_name, list, name_score, corroboration).

    Names match by Jaro-Winkler or equal Soundex; an alert needs a secondary
    identifier in common (both known), or an OFAC_SDN entry with a score of
    `strong`. Jaro-Winkler goes over distinct names by the trie join; a pair
    that only sounds alike needs a common identifier, so it is joined by
    Soundex and identifier. Null names match nothing.
    """
    known = ("dob", "nationality", "national_id")
    s = subjects.select("subject_id", S.person_name(F.col("name")).alias("sn"), *[F.col(c).alias(f"s_{c}") for c in known])
    w = watchlist.select("entry_id", F.col("name").alias("matched_name"), S.person_name(F.col("name")).alias("wn"), "list", *[F.col(c).alias(f"w_{c}") for c in known])
    least = min(threshold, strong)
    pairs = similar_names(s.select("sn"), w.select("wn"), threshold).select(F.col("a").alias("sn"), F.col("b").alias("wn"), "name_score")
    by_name = s.join(pairs, "sn").join(w, "wn")
    ss, ws = s.withColumn("code", S.soundex(F.col("sn"))), w.withColumn("code", S.soundex(F.col("wn")))
    by_sound = None
    for k, c in enumerate(known):  # a pair comes with the first identifier that it has in common
        new = F.lit(True)
        for e in known[:k]:
            new &= F.coalesce(F.col(f"s_{e}") != F.col(f"w_{e}"), F.lit(True))
        one = ss.join(ws.withColumnRenamed("code", "w_code"), (F.col("code") == F.col("w_code")) & (F.col(f"s_{c}") == F.col(f"w_{c}")) & new).drop("w_code")
        by_sound = one if by_sound is None else by_sound.unionByName(one)
    by_sound = by_sound.drop("code").withColumn("name_score", jaro_winkler_udf("sn", "wn")).filter(F.col("name_score") < threshold)
    m = by_name.unionByName(by_sound)
    if least < threshold:  # names that sound alike and reach only `strong`
        more = ss.join(ws.filter("list = 'OFAC_SDN'"), "code").drop("code").withColumn("name_score", jaro_winkler_udf("sn", "wn")).filter((F.col("name_score") >= least) & (F.col("name_score") < threshold))
        m = m.unionByName(more.filter(F.size(_common(known)) == 0))
    m = m.withColumn("corroboration", _common(known))
    return m.filter((F.size("corroboration") > 0) | ((F.col("list") == "OFAC_SDN") & (F.col("name_score") >= strong))).select("subject_id", "entry_id", "matched_name", "list", "name_score", "corroboration")


def _common(known: tuple[str, ...]) -> Column:
    """Which identifiers both sides know and share."""
    return F.array_compact(F.array(*[F.when(F.col(f"s_{c}") == F.col(f"w_{c}"), F.lit(c)) for c in known]))


def rescreen_delta(subjects: DataFrame, old: DataFrame, new: DataFrame, **kw) -> DataFrame:
    """Screens all subjects against the entries that are new only."""
    return screen(subjects, new.exceptAll(old.select(*new.columns)), **kw)


# Allowed moves of a case.
MOVES = {
    "alert": ("triage",),
    "triage": ("investigate",),
    "investigate": ("closed", "escalated", "sar_filed"),
}


def replay_cases(events: DataFrame) -> DataFrame:
    """events (case_id, seq, to_state, actor) -> a row each with from_state, to_state, accepted, error, state, maker, checker.

    Cases start in alert. A move that isn't allowed is an InvalidTransition; a
    SAR needs a maker, who investigated, and another person as checker; such
    rows change nothing. Replayed in seq order inside an array of the case's
    own events.
    """
    ok = F.create_map(*[F.lit(x) for k, v in MOVES.items() for x in (k, ",".join(v))])
    ev = F.sort_array(F.collect_list(F.struct("seq", "to_state", "actor")))
    start = F.struct(F.lit("alert").alias("state"), F.lit(None).cast("string").alias("maker"), F.lit(None).cast("string").alias("checker"),
                     F.array().cast("array<struct<seq:bigint,from_state:string,to_state:string,actor:string,error:string,state:string,maker:string,checker:string>>").alias("log"))

    def step(acc: Column, e: Column) -> Column:
        allowed = F.coalesce(F.array_contains(F.split(F.element_at(ok, acc["state"]), ","), e["to_state"]), F.lit(False))
        sar = e["to_state"] == "sar_filed"
        error = (F.when(~allowed, "InvalidTransition").when(sar & acc["maker"].isNull(), "MissingMaker").when(sar & (acc["maker"] == e["actor"]), "FourEyes"))
        fine = error.isNull()
        state = F.when(fine, e["to_state"]).otherwise(acc["state"])
        maker = F.when(fine & (e["to_state"] == "investigate"), e["actor"]).otherwise(acc["maker"])
        checker = F.when(fine & sar, e["actor"]).otherwise(acc["checker"])
        row = F.struct(e["seq"].cast("bigint").alias("seq"), acc["state"].alias("from_state"), e["to_state"].alias("to_state"), e["actor"].alias("actor"), error.alias("error"), state.alias("state"), maker.alias("maker"), checker.alias("checker"))
        return F.struct(state.alias("state"), maker.alias("maker"), checker.alias("checker"), F.concat(acc["log"], F.array(row)).alias("log"))

    done = events.groupBy("case_id").agg(ev.alias("ev")).select("case_id", F.explode(F.aggregate("ev", start, step)["log"]).alias("x"))
    return done.select("case_id", "x.*").withColumn("accepted", F.col("error").isNull())


def review_queue(cases: DataFrame, risk: str = "risk", seq: str = "case_no") -> DataFrame:
    """Highest risk first, then the order of opening."""
    return cases.orderBy(F.desc(risk), seq)


def next_case(cases: DataFrame, **kw) -> DataFrame:
    return review_queue(cases, **kw).limit(1)


def queue_filter(queue: DataFrame, status: str = "all", analyst: str | None = None, category: str | None = None, text: str = "", cap: int = 44) -> DataFrame:
    """The dashboard's filter: status, alert category (before the colon), text in subject or case id; risk order, capped."""
    q = queue
    closed = F.col("state").isin("closed", "sar_filed")
    if status == "mine":
        q = q.filter(F.col("assignee") == analyst)
    elif status == "open":
        q = q.filter(~closed)
    elif status == "closed":
        q = q.filter(closed)
    if category and "categories" in q.columns:
        q = q.filter(F.array_contains("categories", category))
    elif category:
        q = q.filter(F.exists("alerts", lambda a: F.substring_index(a, ":", 1) == category))
    if text:
        low = text.lower()
        q = q.filter(F.lower("subject").contains(low) | F.lower("case_id").contains(low))
    return q.withColumn("tier", S.risk_tier(F.col("risk"))).orderBy(F.desc("risk"), "case_no").limit(cap)


def open_cases(inputs: DataFrame, screening: DataFrame, aml: DataFrame) -> DataFrame:
    """inputs (arrival, subject_id, acct, risk) with any alert -> numbered cases in risk order, alerts sanctions first, their categories beside them.

    screening has subject_id, entry_id and matched_name; aml has acct, ord and
    typology. Numbers follow arrival. A subject's names come again in each of
    its cases, so they are put in after cases have been numbered and sorted:
    only a subject's one row of them is moved, by broadcast if all fit.
    """
    s = Scratch(inputs.sparkSession, "cases")
    a = s.table(screening.groupBy("subject_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("entry_id", "matched_name"))), lambda x: F.concat(F.lit("sanctions:"), x["matched_name"])).alias("_s")), "names")
    b = aml.groupBy("acct").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "typology"))), lambda x: F.concat(F.lit("aml:"), x["typology"])).alias("_a"))
    none = F.array().cast("array<string>")
    j = inputs.join(a.select("subject_id", F.lit("sanctions").alias("_c")), "subject_id", "left").join(b, "acct", "left").filter("_c is not null or _a is not null")
    numbered = number(j.withColumn("categories", F.array_compact(F.array("_c", F.when(F.col("_a").isNotNull(), "aml")))).drop("_c"), "arrival", "case_no")
    numbered = numbered.withColumn("case_id", F.concat(F.lit("case-"), F.col("case_no"))).withColumn("state", F.lit("alert"))
    size = a.agg(F.sum(F.aggregate("_s", F.lit(0).cast("long"), lambda n, x: n + 32 + F.coalesce(F.octet_length(x), F.lit(0))))).first()[0] or 0
    attach = lambda cases, names: cases.join(names, "subject_id", "left").withColumn("alerts", F.concat(F.coalesce("_s", none), F.coalesce("_a", none))).drop("_s", "_a")
    if size > BROADCAST_BYTES:
        return review_queue(attach(numbered, a))
    # The optimizer drops a sort below a join; it keeps one below a condition that depends on the row's place.
    return attach(review_queue(numbered).filter(F.monotonically_increasing_id() >= 0), F.broadcast(a))


def case_views(cases: DataFrame, ordered: bool = False) -> DataFrame:
    """The analyst's read model, risk order (ordered: they are, as open_cases() leaves them); enrichment arrays are empty until joined."""
    e = F.array().cast("array<string>")
    return (cases if ordered else review_queue(cases)).select("case_id", F.col("subject_id").alias("subject"), "risk", "state", "alerts", e.alias("evidence"), e.alias("reason_codes"), e.alias("graph_links"))


def sar_reports(inputs: DataFrame, c: Sar = Sar()) -> DataFrame:
    """inputs (case_id, subject, typologies, total_amount_minor, detected_at) -> reports with deadlines and narrative."""
    deadline = F.col("detected_at") + F.expr(f"interval {c.filing_window_days} days")
    text = F.format_string("Subject %s exhibited suspicious activity (typologies: %s) totalling %d minor units, detected at %s. Confidential — not for disclosure to the subject.",
                           F.col("subject"), F.array_join("typologies", ", "), F.col("total_amount_minor"), F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return inputs.select("case_id", "subject", "typologies", "total_amount_minor", text.alias("narrative"), "detected_at", deadline.alias("filing_deadline"),
                         (deadline + F.expr(f"interval {c.continuing_activity_days} days")).alias("continuing_activity_review"), F.lit(False).alias("disclose_to_subject"))


def ctr_reports(cash: DataFrame, c: Sar = Sar()) -> DataFrame:
    """Cash movements at or over the threshold, whatever else is suspected."""
    return cash.filter(F.col("cash_amount_minor") >= c.ctr_threshold_minor).select("subject", "cash_amount_minor", "occurred_at")


def disposition_labels(cases: DataFrame) -> DataFrame:
    """closed -> LEGIT, escalated and sar_filed -> FRAUD; open cases teach nothing."""
    v = F.when(F.col("state") == "closed", "LEGIT").when(F.col("state").isin("escalated", "sar_filed"), "FRAUD")
    return cases.withColumn("value", v).filter("value is not null")
