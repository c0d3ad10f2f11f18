"""Scans of nested vendor documents: company facts, submissions, ticker files, bar payloads, strategies.

All schemas are declared, never inferred. Files hold one JSON document each
(``spark.read.text(wholetext=True)``) or one per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowntime.functions import scalars as S

OBSERVATION = "struct<start:string,end:string,val:string,accn:string,fy:string,fp:string,form:string,filed:string,frame:string>"
COMPANY_FACTS = f"struct<cik:string,entityName:string,facts:map<string,map<string,struct<label:string,description:string,units:map<string,array<{OBSERVATION}>>>>>>"
_ARRAYS = ("accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form", "fileNumber", "filmNumber", "primaryDocument", "isXBRL", "isInlineXBRL")
ARCHIVE = "struct<" + ",".join(f"{a}:array<string>" for a in _ARRAYS) + ">"
_FILE = "array<struct<name:string>>"
SUBMISSIONS = (
    "struct<cik:string,name:string,entityType:string,sic:string,sicDescription:string,fiscalYearEnd:string,stateOfIncorporation:string,stateOfIncorporationDescription:string,"
    f"tickers:array<string>,exchanges:array<string>,files:{_FILE},filings:struct<recent:{ARCHIVE},files:{_FILE}>>"
)
TICKERS = "map<string,struct<cik_str:string,ticker:string,title:string>>"
PAYLOAD = (
    "struct<meta:struct<symbol:string,currency:string,exchange_timezone:string,timezone:string>,"
    "values:array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>,status:string,code:string,message:string>"
)
STRATEGY = (
    "name string, description string, tickers array<string>, factor string, top_n int, baseline string, start_date date, end_date date, schedule string, explicit_dates array<date>,"
    "calendar_symbol string, benchmark_symbol string, cost_bps double, initial_nav double, provider string, adjustment_mode string"
)


def company_facts(docs: DataFrame, filings: DataFrame) -> DataFrame:
    """(doc COMPANY_FACTS) -> one row per distinct observation with its availability.

    Booleans, nulls and text that is no number are dropped, thousands commas
    accepted. The filing's acceptance, date and form come by a join on accession;
    equal facts keep their earliest availability.
    """
    from knowntime.operators.pit import first_known

    rows = (
        docs.select(S.normalize_cik(F.col("doc.cik")).alias("cik"), F.explode("doc.facts").alias("taxonomy", "concepts"))
        .select("cik", "taxonomy", F.explode("concepts").alias("concept", "c"))
        .select("cik", "taxonomy", "concept", F.col("c.label").alias("label"), F.explode("c.units").alias("unit", "obs"))
        .select("cik", "taxonomy", "concept", "unit", F.explode("obs").alias("o"))
        .where(~F.lower("o.val").isin("true", "false"))
        .select("cik", "taxonomy", "concept", "unit", S.lenient_number(F.col("o.val")).alias("value"), S.lenient_date(F.col("o.start")).alias("start_date"), S.lenient_date(F.col("o.end")).alias("end_date"), F.nullif(F.trim("o.accn"), F.lit("")).alias("accession_number"),
                S.lenient_int(F.col("o.fy")).alias("fiscal_year"), F.col("o.fp").alias("fiscal_period"), F.col("o.form").alias("__form"), S.lenient_date(F.col("o.filed")).alias("__filed"), F.col("o.frame").alias("frame"))
        .where(F.col("value").isNotNull())
    )
    known = filings.select("accession_number", F.col("filing_date").alias("__filing_date"), "acceptance_datetime", F.col("form").alias("__filing_form")).dropDuplicates(["accession_number"])
    joined = rows.join(known, "accession_number", "left").withColumns({"filing_date": F.coalesce("__filing_date", "__filed"), "form": F.coalesce("__form", "__filing_form")})
    joined = joined.withColumn("available_at", S.filing_available_at(F.col("acceptance_datetime"), F.col("filing_date")))
    out = joined.withColumn("fact_id", S.fact_key())
    return first_known(out.select("cik", "taxonomy", "concept", "unit", "value", "start_date", "end_date", "filing_date", "acceptance_datetime", "available_at", "accession_number", "form", "fiscal_year", "fiscal_period", "frame", "fact_id"))


def filing_arrays(submissions: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """(doc SUBMISSIONS), (cik, doc ARCHIVE) -> (cik, part, arrays): the recent arrays, then archived ones."""
    recent = submissions.select(S.normalize_cik(F.col("doc.cik")).alias("cik"), F.lit(0).alias("part"), F.col("doc.filings.recent").alias("arrays"))
    if archives is None:
        return recent
    order = F.row_number().over(Window.partitionBy("cik").orderBy("path")) if "path" in archives.columns else F.lit(1)
    return recent.unionByName(archives.select("*", order.alias("part")).select(S.normalize_cik(F.col("cik")).alias("cik"), "part", F.col("doc").alias("arrays")), allowMissingColumns=True)


def filings(arrays: DataFrame) -> DataFrame:
    """Parallel arrays -> one row per (cik, accession), the first occurrence.

    Short arrays are padded with nulls, entries without accession or filing date
    dropped, a blank form becomes UNKNOWN.
    """
    a = lambda n: F.col(f"z.{n}")
    none = F.array().cast("array<string>")
    zipped = arrays.select("cik", "part", F.posexplode(F.arrays_zip(*[F.coalesce(F.col(f"arrays.{n}"), none).alias(n) for n in _ARRAYS])).alias("pos", "z"))
    rows = zipped.select(
        "cik", "part", "pos", F.nullif(F.trim(a("accessionNumber")), F.lit("")).alias("accession_number"), S.lenient_date(a("filingDate")).alias("filing_date"), S.lenient_date(a("reportDate")).alias("report_date"), S.acceptance_instant(a("acceptanceDateTime")).alias("acceptance_datetime"),
        F.coalesce(F.nullif(F.trim(a("form")), F.lit("")), F.lit("UNKNOWN")).alias("form"), a("fileNumber").alias("file_number"), a("filmNumber").alias("film_number"), a("primaryDocument").alias("primary_document"), S.lenient_bool(a("isXBRL")).alias("is_xbrl"), S.lenient_bool(a("isInlineXBRL")).alias("is_inline_xbrl"),
    ).where(F.col("accession_number").isNotNull())
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("cik", "accession_number").orderBy("part", "pos"))).where("rn = 1 and filing_date is not null")
    return first.withColumn("available_at", S.filing_available_at(F.col("acceptance_datetime"), F.col("filing_date"))).drop("rn", "part", "pos")


def archive_manifest(submissions: DataFrame) -> DataFrame:
    """(cik, position, name): distinct trimmed archive names from both places, first-seen order."""
    none = F.array().cast(_FILE)
    names = F.array_distinct(F.array_compact(F.transform(F.concat(F.coalesce("doc.filings.files", none), F.coalesce("doc.files", none)), lambda f: F.nullif(F.trim(f["name"]), F.lit("")))))
    return submissions.select(S.normalize_cik(F.col("doc.cik")).alias("cik"), F.posexplode(names).alias("position", "name"))


def issuers(submissions: DataFrame) -> DataFrame:
    cik = S.normalize_cik(F.col("doc.cik"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return submissions.select(
        cik.alias("cik"), F.coalesce(text("doc.name"), F.concat(F.lit("CIK "), cik)).alias("legal_name"), text("doc.entityType").alias("entity_type"), text("doc.sic").alias("sic"), text("doc.sicDescription").alias("sic_description"),
        text("doc.fiscalYearEnd").alias("fiscal_year_end"), F.coalesce(text("doc.stateOfIncorporation"), text("doc.stateOfIncorporationDescription")).alias("state_of_incorporation"),
    ).where(F.col("cik").isNotNull())


def securities(submissions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Tickers with their exchange by position, plus the resolved (cik, ticker, exchange) ones,
    which become primary and fill a missing exchange. Without a resolved ticker the first is primary."""
    zipped = submissions.select(S.normalize_cik(F.col("doc.cik")).alias("cik"), F.posexplode(F.arrays_zip(F.col("doc.tickers").alias("t"), F.coalesce("doc.exchanges", F.array().cast("array<string>")).alias("x"))).alias("pos", "z"))
    listed = zipped.select("cik", "pos", S.canonical_symbol(F.col("z.t")).alias("ticker"), F.nullif(F.trim("z.x"), F.lit("")).alias("exchange")).where(F.col("ticker").isNotNull())
    listed = listed.groupBy("cik", "ticker").agg(F.min("pos").alias("pos"), F.min_by("exchange", "pos").alias("exchange"))
    chosen = resolved.select(S.normalize_cik(F.col("cik")).alias("cik"), S.canonical_symbol(F.col("ticker")).alias("ticker"), F.col("exchange").alias("__x"), F.lit(True).alias("__chosen")).dropDuplicates(["cik", "ticker"])
    both = listed.join(chosen, ["cik", "ticker"], "full_outer")
    w = Window.partitionBy("cik")
    primary = F.coalesce(F.col("__chosen"), (F.col("pos") == F.min("pos").over(w)) & F.coalesce(F.max("__chosen").over(w), F.lit(False)).eqNullSafe(False))
    return both.select("cik", "ticker", F.coalesce("exchange", "__x").alias("exchange"), F.coalesce(primary, F.lit(False)).alias("is_primary"))


def ticker_entries(docs: DataFrame) -> DataFrame:
    """(doc TICKERS) -> (position, ticker, cik, title)."""
    rows = docs.select(F.explode("doc").alias("k", "e"))
    return rows.select(F.col("k").try_cast("int").alias("position"), S.canonical_symbol(F.col("e.ticker")).alias("ticker"), S.normalize_cik(F.col("e.cik_str")).alias("cik"), F.col("e.title").alias("title"))


def resolve_tickers(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(ticker) -> ticker, cik, title, found; the first entry of a ticker counts."""
    first = entries.groupBy("ticker").agg(F.min_by(F.struct("cik", "title"), "position").alias("e"))
    asked = requests.select(S.canonical_symbol(F.col("ticker")).alias("ticker")).distinct()
    return asked.join(first, "ticker", "left").select("ticker", "e.cik", "e.title", F.col("e.cik").isNotNull().alias("found"))


def payload_fault(doc: Column) -> Column:
    """What kind of error a whole payload is, null for one with values: auth, rate_limit, upstream
    (code of 500 or more), symbol, provider_error, or no_values."""
    code, said = doc["code"].try_cast("int"), F.lower(F.coalesce(doc["message"], doc["status"], F.lit("")))
    error = (F.lower(F.trim(F.coalesce(doc["status"], F.lit("")))) == "error") | F.coalesce(code >= 400, F.lit(False))
    kind = F.when(said.contains("api key") | code.isin(401, 403), "auth").when(code == 429, "rate_limit").when(code >= 500, "upstream").when(said.contains("symbol") | code.isin(400, 404), "symbol").otherwise("provider_error")
    return F.when(error, kind).when(doc["values"].isNull(), "no_values")


def payload_errors(docs: DataFrame) -> DataFrame:
    """(symbol, adjustment_mode, doc PAYLOAD) -> (symbol, adjustment_mode, fault, retry, code, message) of the
    payloads without bars; asking again later may help with a rate limit or an upstream error."""
    marked = docs.withColumn("fault", payload_fault(F.col("doc"))).where("fault is not null")
    return marked.select("symbol", "adjustment_mode", "fault", F.col("fault").isin("rate_limit", "upstream").alias("retry"), F.col("doc.code").try_cast("int").alias("code"), F.col("doc.message").alias("message"))


def bar_payloads(docs: DataFrame, zones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbol, adjustment_mode, doc PAYLOAD) -> (typed bars, rejected rows with reasons).

    Malformed rows, and all rows of a payload without currency or time zone, are
    rejected, and so is a payload that is an error, as one row; an empty list of values
    gives neither. A zone that is not in ``zones(zone)`` counts
    as missing: Spark would stop the job at it. Without ``zones``, Spark's own list is used.
    Bars carry ``available_at``, 16:15 of their day in their zone.
    """
    from knowntime.operators.quality import known_zones, with_known_zone

    # a filter on what explode makes stays above it; below, each mention of doc would parse its text again
    docs = docs.select("symbol", "adjustment_mode", F.explode(F.array("doc")).alias("doc"))
    zone = F.coalesce(F.nullif(F.trim("doc.meta.exchange_timezone"), F.lit("")), F.nullif(F.trim("doc.meta.timezone"), F.lit("")))
    told = F.to_json(F.struct("doc.status", "doc.code", "doc.message")).alias("raw")
    errors = docs.withColumn("__fault", payload_fault(F.col("doc"))).where("__fault is not null").select("symbol", "adjustment_mode", told, F.array("__fault").alias("faults"))
    rows = docs.where(payload_fault(F.col("doc")).isNull()).select("symbol", "adjustment_mode", F.nullif(F.trim("doc.meta.currency"), F.lit("")).alias("currency"), zone.alias("exchange_timezone"), F.explode("doc.values").alias("b"))
    price = lambda c: F.regexp_replace(F.trim(c), ",", "").try_cast("decimal(18,6)")
    volume = F.regexp_replace(F.trim("b.volume"), ",", "").try_cast("double")
    typed = rows.select(
        "symbol", "adjustment_mode", "currency", "exchange_timezone", S.lenient_date(F.col("b.datetime")).alias("trading_date"), *[price(f"b.{n}").alias(n) for n in ("open", "high", "low", "close")],
        F.when(volume == F.floor(volume), volume.cast("long")).alias("volume"), F.to_json("b").alias("raw"),
    )
    faults = F.array_compact(
        F.array(
            F.when(F.col("currency").isNull(), F.lit("missing_currency")), F.when(F.col("exchange_timezone").isNull(), F.lit("missing_timezone")), F.when(F.col("trading_date").isNull(), F.lit("malformed_date")),
            *[F.when(F.col(n).isNull(), F.lit(f"malformed_{n}")) for n in ("open", "high", "low", "close", "volume")],
        )
    )
    marked = with_known_zone(typed, zones if zones is not None else known_zones(docs.sparkSession)).withColumn("faults", faults)
    good = marked.where(F.size("faults") == 0).drop("raw", "faults")
    bad = marked.where(F.size("faults") > 0).select("symbol", "adjustment_mode", "raw", "faults").unionByName(errors)
    return good.withColumn("available_at", S.bar_available_at(F.col("trading_date"), F.col("exchange_timezone"))), bad


def strategies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object per line -> (requests with fingerprint, rejected lines with reasons).

    Unknown and repeated fields are rejected, and so are invalid requests.
    """
    names = [f.split()[0] for f in STRATEGY.split(",") if f.strip()]
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", STRATEGY).alias("s"), F.json_object_keys("value").alias("k"))
    shape = F.array_compact(
        F.array(
            F.when(F.col("s").isNull() | F.col("k").isNull(), F.lit("not_an_object")),
            F.when(F.size(F.array_except("k", F.array(*map(F.lit, names)))) > 0, F.lit("unknown_field")),
            F.when(F.size("k") > F.size(F.array_distinct("k")), F.lit("duplicate_field")),
        )
    )
    rows = lines.select("value", shape.alias("shape"), "s.*")
    rows = rows.withColumn("faults", F.concat("shape", S.request_faults()))
    economic = {n: F.col(n) for n in names if n not in ("name", "description")}
    good = rows.where(F.size("faults") == 0).withColumn("fingerprint", S.request_fingerprint(economic)).drop("value", "shape", "faults")
    return good, rows.where(F.size("faults") > 0).select("value", "faults")
