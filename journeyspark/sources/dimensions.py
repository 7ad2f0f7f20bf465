"""Reference dimensions: code tables of profiles, touchpoints and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes and their names.
DIMENSIONS: dict[str, dict[int, str]] = {
    "GenderID": {1: "Male", 2: "Female"},
    "BAS_werkzaamheid_resp": {
        1: "Entrepreneur", 2: "Salaried employment", 3: "Working for the government", 4: "Incapacitated",
        5: "Unemployed / job seeker", 6: "Social assistance benefit", 7: "(Early) retirement", 8: "Student / scholar",
        9: "Housewife / houseman / other", 97: "Don't know", 99: "Not applicable",
    },
    "SPSS_Regio5": {1: "Amsterdam, Rotterdam, Den Haag", 2: "West (Randstad excluded)", 3: "North", 4: "East", 5: "South"},
    "BAS_bruto_jaarinkomen": {
        1: "Under 12,900 (minimum)", 2: "12,900 to 27,000 (below average)", 3: "27,000 to 33,500 (almost average)",
        4: "33,500 to 40,000 (average)", 5: "40,000 to 67,000 (1 to 2x average)", 6: "67,000 to 79,900 (2x average)",
        7: "Over 79,900 (above 2x average)", 8: "Don't know / don't want to say",
    },
    "AFG_sk2015": {1: "A — high status", 2: "B1 — above average", 3: "B2 — average", 4: "C — below average", 5: "D — low status"},
    "BAS_voltooide_opleiding8_resp": {
        1: "No or primary education", 2: "Lower secondary / vocational / MBO level 1", 3: "Upper secondary (MAVO, HAVO, VWO)",
        4: "MBO levels 2, 3, 4", 5: "Senior secondary (HAVO, VWO with diploma)", 6: "Higher education, propedeuse",
        7: "Higher education, bachelor", 8: "Higher education, master or doctorate", 97: "Don't know / don't want to say", 99: "Not applicable",
    },
    "SPSS_Lifestage": {
        1: "Young singles", 2: "Mature singles", 3: "Young couples", 4: "Empty nesters", 5: "Young families", 6: "Mature families",
        7: "Established families", 8: "Single parents, child(ren)", 9: "Single parents, adult child(ren)", 97: "Unknown",
    },
    "type_touch": {
        1: "Accommodation website", 2: "Accommodation app", 3: "Accommodation search", 4: "Information / comparison website",
        5: "Information / comparison app", 6: "Information / comparison search", 7: "Competitor website", 8: "Competitor app",
        9: "Competitor search", 10: "Focus brand website", 12: "Focus brand search", 13: "Flight ticket website",
        14: "Flight ticket app", 15: "Flight ticket search", 16: "Generic search", 18: "Affiliate", 19: "Display banner",
        20: "Email", 21: "Video preroll", 22: "Retargeting",
    },
    "cluster_info": {-1: "Noise", 0: "Empty nesters & mature singles", 1: "Mature & established families", 2: "Young singles & young couples"},
}


def dimension(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(list(DIMENSIONS[name].items()), "code int, name string")


def all_dimensions(spark: SparkSession) -> DataFrame:
    rows = [(d, c, n) for d, table in DIMENSIONS.items() for c, n in table.items()]
    return spark.createDataFrame(rows, "dimension string, code int, name string")


def resync(current: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """Upsert: wanted rows replace those of the same key; running it again changes nothing."""
    return current.join(wanted.select(*key), list(key), "left_anti").unionByName(wanted)


def label(df: DataFrame, code: str, name: str, as_: str, fallback: str | None = None) -> DataFrame:
    """Left join of a code to its name; unmapped codes give null, or the fallback before the code."""
    dim = dimension(df.sparkSession, name).select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    got = F.col("_name") if fallback is None else F.coalesce("_name", F.concat(F.lit(fallback), F.col(code).cast("string")))
    return df.join(F.broadcast(dim), F.col(code) == F.col("_code"), "left").withColumn(as_, got).drop("_code", "_name")


def valid_codes(spark: SparkSession, name: str) -> DataFrame:
    return dimension(spark, name).select("code").distinct()


def options(spark: SparkSession, name: str) -> DataFrame:
    return dimension(spark, name).orderBy("code")


def sql_values(name: str) -> str:
    """The dimension as a SQL relation (code, name)."""
    return "(VALUES " + ", ".join(f"({c}, '{n.replace(chr(39), chr(39) * 2)}')" for c, n in DIMENSIONS[name].items()) + ") AS dim(code, name)"
