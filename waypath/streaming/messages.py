"""Flight messages in XML: parsing, filters, choice of times. For batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Message types that carry times. Fixed values of the feed.
TYPES = ("departureInformation", "flightPlanAmendmentInformation", "flightPlanInformation", "arrivalInformation", "flightPlanFiledInformation")

_TIMES = "struct<etd: array<struct<_etdType: string, _timeValue: string>>, eta: array<struct<_etaType: string, _timeValue: string>>>"
SCHEMA = f"""fltdMessage array<struct<_acid: string, _airline: string, _depArpt: string, _arrArpt: string, _flightRef: string, _msgType: string,
  _sourceFacility: string, _sourceTimeStamp: string, gufi: string, igtd: string, ncsmFlightTimeData: {_TIMES},
  departureInformation: struct<ncsmFlightTimeData: {_TIMES}>>>, _corrupt string"""


def parsed(df: DataFrame, xml: str = "xml") -> DataFrame:
    """``df`` with column ``doc``: the document, or null fields and its text in ``doc._corrupt`` where it can't be read."""
    plain = F.regexp_replace(F.col(xml), "(</?)[A-Za-z0-9_]+:", "$1")
    return df.withColumn("doc", F.from_xml(plain, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def malformed(df: DataFrame) -> Column:
    return F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()


def _time(times: Column, kind: str, value: Column | None = None) -> Column:
    """The last ACTUAL time, else the first ESTIMATED one."""
    of = lambda t: F.filter(times, lambda x: x[f"_{kind}Type"] == t)
    actual, estimated = of("ACTUAL"), of("ESTIMATED")
    return F.coalesce(F.try_element_at(actual, F.lit(-1))["_timeValue"], F.try_element_at(estimated, F.lit(1))["_timeValue"])


def instant(c: Column) -> Column:
    """An ISO time in UTC; null if it can't be read."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ss"))).cast("timestamp_ntz")


def records(df: DataFrame, blocked: DataFrame | None = None, types: tuple[str, ...] = TYPES) -> DataFrame:
    """One row per message of a kept type with a scheduled departure; callsigns in ``blocked`` (callsign) go."""
    m = df.where(~malformed(df)).select(F.explode("doc.fltdMessage").alias("m")).where(F.col("m._msgType").isin(*types))
    etd = F.coalesce("m.departureInformation.ncsmFlightTimeData.etd", "m.ncsmFlightTimeData.etd")
    eta = F.coalesce("m.departureInformation.ncsmFlightTimeData.eta", "m.ncsmFlightTimeData.eta")
    out = m.select(
        F.upper("m._acid").alias("callsign"),
        F.col("m._airline").alias("carrier"),
        F.col("m._depArpt").alias("origin"),
        F.col("m._arrArpt").alias("dest"),
        F.trim("m.gufi").alias("flight_id"),
        F.col("m._msgType").alias("message_type"),
        instant(F.trim("m.igtd")).alias("dep_sched"),
        instant(_time(etd, "etd")).alias("dep_actual"),
        instant(_time(eta, "eta")).alias("arr_actual"),
    ).where("dep_sched is not null")
    out = out.withColumn("dep_delay", F.round(F.timestamp_diff("SECOND", "dep_sched", "dep_actual") / 60.0, 1))
    return out if blocked is None else out.join(blocked, "callsign", "left_anti")
