"""Capture snapshots in JSON, one object for each (URL, viewport), and the long tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARRAYS = ("colors", "fontFamilies", "fontSizes", "fontWeights", "lineHeights", "letterSpacings", "spacings", "radii", "shadows", "borders", "backgroundColors", "textColors", "zIndices", "transitions")
_RECT = "struct<x:double,y:double,width:double,height:double>"
STYLES = "struct<" + ",".join(f"{a}:array<string>" for a in _ARRAYS) + ",cssVariables:map<string,string>,usageCount:map<string,double>,valueSources:map<string,array<string>>,colorRoleObservations:array<struct<captureId:string,elementRef:string,elementKind:string,role:string,statusKind:string,statusIntent:string,background:string,foreground:string,borderColor:string>>>"
HEALTH = "struct<status:string,recovered:boolean,attempts:int,overlayAreaRatio:double,mutationCount:int,issues:array<struct<code:string,severity:string,recoverable:boolean,detail:string>>>"
SECTIONS = f"array<struct<key:string,parentKey:string,role:string,layoutMode:string,order:int,rect:{_RECT},styles:map<string,string>>>"
COMPONENTS = f"array<struct<key:string,sectionKey:string,type:string,elementKind:string,role:string,rect:{_RECT},styles:map<string,string>,confidence:double>>"
SCHEMA = f"analysisId string, url string, viewport string, viewportWidth double, capturedAt timestamp, styles {STYLES}, health {HEALTH}, sections {SECTIONS}, components {COMPONENTS}, _corrupt_record string"


def schema() -> T.StructType:
    return T._parse_datatype_string(SCHEMA)  # noqa: SLF001


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row for each capture; an object that does not fit has _corrupt_record and nothing else."""
    return spark.read.schema(schema()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def usage_table(captures: DataFrame) -> DataFrame:
    """analysisId, url, viewport, category, value, weight from the usage maps, whose keys are category:value."""
    rows = captures.select("analysisId", "url", "viewport", F.explode("styles.usageCount").alias("key", "weight"))
    at = F.instr("key", ":")
    return rows.select("analysisId", "url", "viewport", F.expr("left(key, instr(key, ':') - 1)").alias("category"), F.expr("substr(key, instr(key, ':') + 1)").alias("value"), "weight").where(at.isNotNull() & F.col("category").isNotNull())


def source_table(captures: DataFrame) -> DataFrame:
    """analysisId, url, viewport, key, source."""
    rows = captures.select("analysisId", "url", "viewport", F.explode("styles.valueSources").alias("key", "sources"))
    return rows.select("analysisId", "url", "viewport", "key", F.explode("sources").alias("source"))


def value_table(captures: DataFrame) -> DataFrame:
    """analysisId, url, viewport, field, ord, value from the array fields."""
    out = None
    for name in _ARRAYS:
        part = captures.select("analysisId", "url", "viewport", F.lit(name).alias("field"), F.posexplode(F.col("styles")[name]).alias("ord", "value"))
        out = part if out is None else out.unionByName(part)
    return out


def entity_table(captures: DataFrame, field: str) -> DataFrame:
    """analysisId, url, viewport, ord and the fields of each element of sections or components."""
    rows = captures.select("analysisId", "url", "viewport", F.posexplode(field).alias("ord", "_e"))
    return rows.select("analysisId", "url", "viewport", "ord", "_e.*")


def observation_table(captures: DataFrame) -> DataFrame:
    """analysisId, ord, role, status_kind, status_intent, background, foreground, element from the observed colour roles; ord follows URL, viewport and place."""
    rows = captures.select("analysisId", "url", "viewport", F.posexplode("styles.colorRoleObservations").alias("pos", "_o"))
    at = F.struct("url", "viewport", "pos")
    return rows.select("analysisId", at.alias("ord"), F.col("_o.role").alias("role"), F.col("_o.statusKind").alias("status_kind"), F.col("_o.statusIntent").alias("status_intent"), F.col("_o.background").alias("background"), F.col("_o.foreground").alias("foreground"), F.concat_ws("|", "url", "viewport", "_o.elementRef").alias("element"))
