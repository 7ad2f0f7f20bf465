"""Cleaning: numeric coercion, keys, dedupe, sparsity, timestamps, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeyspark.sources.dimensions import DIMENSIONS


def number(c) -> Column:
    """Text to double; what is no number is null."""
    return F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Columns as doubles; those that the table lacks are skipped."""
    return df.withColumns({c: number(c) for c in columns if c in df.columns})


def coercion_losses(df: DataFrame, columns) -> DataFrame:
    """(column, lost): values that are there but no numbers; one pass."""
    have = [c for c in columns if c in df.columns]
    lost = df.agg(*[F.count_if(F.col(c).isNotNull() & number(c).isNull()).alias(c) for c in have])
    return lost.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("lost")) for c in have])).alias("x")).select("x.*")


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key, the key as a long."""
    return df.withColumn(key, number(key).cast("long")).where(F.col(key).isNotNull())


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; dropDuplicates would take any."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def missing_share(columns) -> Column:
    return F.array_size(F.filter(F.array(*[F.col(c).isNull() for c in columns]), lambda gap: gap)) / F.lit(len(columns))


def sparsity_filter(df: DataFrame, columns, most: float = 0.5) -> DataFrame:
    """Without rows of which more than `most` of the columns are missing; exactly that share stays, all missing never does.

    Spark puts what makes the columns into the condition, once for each time that it names the share, so it does so once.
    """
    few = max(i for i in range(-1, len(columns)) if i < 0 or i / len(columns) <= most)
    return df.where(missing_share(columns) <= few / len(columns))


def positive_duration(df: DataFrame, column: str = "duration") -> DataFrame:
    return df.where(F.coalesce(column, F.lit(0.0)) > 0)


def parse_time(c: str, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def clean_clicks(raw: DataFrame, user="user_id", ts="ts", touch="touch", duration="duration") -> DataFrame:
    """Rows with user, time and touch, and then a positive duration; numbers and times parsed."""
    parsed = raw.withColumns({user: number(user).cast("long"), touch: number(touch).cast("int"), duration: number(duration)})
    if dict(raw.dtypes)[ts] == "string":
        parsed = parsed.withColumn(ts, parse_time(ts))
    return positive_duration(parsed.where(F.col(user).isNotNull() & F.col(ts).isNotNull() & F.col(touch).isNotNull()), duration)


def stage_report(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n_rows) for every stage."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.lit(name).alias("stage"), F.count("*").alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


def fill_value(df: DataFrame, columns, value) -> DataFrame:
    return df.fillna(value, subset=list(columns))


# Fields of a prediction form, their bounds or code tables.
BOUNDS = {"Age": (0, 120), "BAS_huishoudgrootte": (1, 30), "afg_kinderen_huishouden": (0, 30)}
CODED = {
    "GenderID": "GenderID", "SPSS_Regio5": "SPSS_Regio5", "BAS_werkzaamheid_resp": "BAS_werkzaamheid_resp",
    "BAS_bruto_jaarinkomen": "BAS_bruto_jaarinkomen", "AFG_sk2015": "AFG_sk2015",
    "BAS_voltooide_opleiding8_resp": "BAS_voltooide_opleiding8_resp", "SPSS_Lifestage": "SPSS_Lifestage",
    "step_1_channel": "type_touch", "step_2_channel": "type_touch",
}


def form_number(c: str) -> Column:
    """A whole number, with outer spaces and one trailing plus allowed."""
    return F.regexp_extract(F.trim(c), r"^([+-]?\d{1,9})\+?$", 1).try_cast("int")


def name_to_code(c: str, name: str = "type_touch") -> Column:
    """The code of a name in any case; null if there is none."""
    pairs = [x for code, label in DIMENSIONS[name].items() for x in (F.lit(label.lower()), F.lit(code))]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(c)))


def validate_form(df: DataFrame) -> DataFrame:
    """Each field as an int in `values`, and `errors`: field to required, not_a_number, out_of_range or unknown_code."""
    values, errors = [], []
    for f in [*BOUNDS, *CODED]:
        v = form_number(f) if CODED.get(f) != "type_touch" else F.coalesce(form_number(f), name_to_code(f))
        bad = F.when(F.coalesce(F.trim(f), F.lit("")) == "", "required").when(v.isNull(), "not_a_number")
        if f in BOUNDS:
            bad = bad.when(~v.between(*BOUNDS[f]), "out_of_range")
        else:
            bad = bad.when(~v.isin(*DIMENSIONS[CODED[f]]), "unknown_code")
        values.append(v.alias(f))
        errors.append(F.struct(F.lit(f).alias("field"), bad.alias("error")))
    kept = F.filter(F.array(*errors), lambda e: e["error"].isNotNull())
    return df.withColumns({"values": F.struct(*values), "errors": F.map_from_entries(kept)})


def to_features(validated: DataFrame) -> DataFrame:
    """Valid rows in the model's columns: step2 is the newer channel, step3 the one before it."""
    ok = validated.where(F.size("errors") == 0)
    own = [c for c in [*BOUNDS, *CODED] if not c.startswith("step_")]
    return ok.select("*", *[F.col(f"values.{c}").alias(f"f_{c}") for c in own], F.col("values.step_2_channel").alias("step2"), F.col("values.step_1_channel").alias("step3"))
