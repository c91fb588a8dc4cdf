"""Scene, sonar, image, ranking and telemetry views over the driver's tables, in one text for both engines.

``spark_view`` plans a view on a session; ``ctes`` gives the same views as common table expressions for DuckDB. Derived
values are rounded to six digits in the view, so that both engines start from equal numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from pelagia.session import table

#: A view's text. {e:i} is the i-th embedding component as double; {code:x} the code point of character x; {chars:t} the characters c of text t at i.
TEXTS = {
    "splats": """select vec_id as gid, label as scene,
  round(6 * {e:1}, 6) as x, round(6 * {e:2}, 6) as y, round(6 * {e:3}, 6) as z,
  round(1 / sqrt(1 + {e:5} * {e:5} + {e:6} * {e:6} + {e:7} * {e:7}), 6) as qw,
  round({e:5} / sqrt(1 + {e:5} * {e:5} + {e:6} * {e:6} + {e:7} * {e:7}), 6) as qx,
  round({e:6} / sqrt(1 + {e:5} * {e:5} + {e:6} * {e:6} + {e:7} * {e:7}), 6) as qy,
  round({e:7} / sqrt(1 + {e:5} * {e:5} + {e:6} * {e:6} + {e:7} * {e:7}), 6) as qz,
  round(exp(-2 + 2 * {e:8}), 6) as sx, round(exp(-2 + 2 * {e:9}), 6) as sy, round(exp(-2 + 2 * {e:10}), 6) as sz,
  round(1 / (1 + exp(-8 * {e:11})), 6) as o, round(1 / (1 + exp(-8 * {e:12})), 6) as r, round(1 / (1 + exp(-8 * {e:13})), 6) as g,
  round(1 / (1 + exp(-8 * {e:14})), 6) as b, round(1 / (1 + exp(-8 * {e:15})), 6) as refl, round(1 / (1 + exp(-8 * {e:16})), 6) as sat
  from embeddings""",
    "cams": """select r_regionkey as cam, round(cos(2 * pi() * r_regionkey / 25), 9) as ca, round(sin(2 * pi() * r_regionkey / 25), 9) as sa,
  cast(0 as double) as tx, cast(0 as double) as ty, cast(6 as double) as tz, cast(40 + r_regionkey as double) as fx, cast(40 as double) as fy,
  cast(32 + 3 * r_regionkey as double) as cx, cast(24 - 2 * r_regionkey as double) as cy, 64 as width, 48 as height, 16 as tile from region""",
    "sonar_px": """select cast(l_suppkey % 20 as int) as frame, cast(l_partkey % 64 as int) as rng, cast(l_orderkey % 48 as int) as az,
  round(avg(cast(l_quantity as double)) / 50, 6) as v from lineitem group by 1, 2, 3""",
    "cloud_a": """select p_partkey as pid, cast(p_partkey * 37 % 101 as double) / 10 as x, cast(p_partkey * 53 % 97 as double) / 10 as y,
  cast(p_size as double) / 10 as z from part""",
    "cloud_b": """select c_custkey as pid, cast((c_custkey * 37 + 7) % 101 as double) / 10 as x, cast((c_custkey * 53 + 7) % 97 as double) / 10 as y,
  cast(c_custkey % 50 + 1 as double) / 10 as z from customer""",
    "img_px": """select doc_id as img, cast(i {div} 16 as int) as py, cast(i % 16 as int) as px, {code:c} % 256 as v from (select doc_id, {chars:text} from documents)""",
    "scores": """select doc_id as idx, source as scene, concat(source, '/', cast(doc_id as {str})) as path,
  round(1 - 1 / (1 + cast(n_chars as double) / 1000), 6) as clip, round(cast(n_chars % 97 as double) / 97, 6) as entropy,
  round(cast(n_chars % 31 as double) / 31, 6) as edge, doc_id as scan from documents""",
    "catalog": """select cast(l_suppkey as int) as dataset, concat(l_returnflag, l_linestatus) as cls, count(*) as n from lineitem group by 1, 2""",
    "telemetry": """select user_id as run, cast(row_number() over (partition by user_id order by ts, event_id) as int) as step, value, event_type as kind from events""",
    "nav": """select user_id as session, event_id, round(20 + value / 1000, 9) as lat, round(30 + cast(event_id % 1000 as double) / 1000, 9) as lon,
  -cast(event_id % 50 as double) as alt, round(cast(event_id % 360 as double) * pi() / 180, 9) as yaw from events""",
    "observations": """select cast(l_partkey % 500 as int) as gid, cast(l_discount as double) / 250 as grad, cast(l_quantity as double) / 64 as radius from lineitem""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(name: str, duck: bool) -> str:
    text = TEXTS[name]
    text = re.sub(r"\{e:(\d+)\}", r"cast(embedding[\1] as double)" if duck else r"cast(element_at(embedding, \1) as double)", text)
    text = text.replace("{div}", "//" if duck else "div").replace("{str}", "varchar" if duck else "string")
    text = re.sub(r"\{code:((?:[^{}])*)\}", r"unicode(\1)" if duck else r"ascii(\1)", text)
    return re.sub(r"\{chars:(\w+)\}", r"unnest(string_split(\1, '')) as c, unnest(range(0, length(\1))) as i" if duck else r"posexplode(split(\1, '')) as (i, c)", text)


_CODES = "transform(split(text, ''), c -> cast(ascii(c) % 256 as smallint))"


def placed(texts: DataFrame) -> DataFrame:
    """w and v in place of ``text``: the image rows of img_px, where an empty text has no pixel."""
    return texts.withColumns({"w": F.lit(16), "v": F.expr(f"if(text = '', cast(array() as array<smallint>), {_CODES})")}).drop("text")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view, or the table of that name, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "telemetry":  # numbered by ranges: a user may have a third of all events
        from pelagia.operators.scans import numbered

        events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
        return numbered(events, ["user_id"], ["ts", "event_id"]).selectExpr("user_id as run", "cast(_g + 1 as int) as step", "value", "event_type as kind")
    if name == "img_rows":  # the images of img_px, each in a row: img, w, v
        return table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id as img", "16 as w", f"{_CODES} as v")
    if name == "img_texts":  # what ``placed`` makes images of
        return table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id as img", "text")
    if name == "img_places":
        return placed(spark_view(spark, sf_dir, "img_texts"))
    text = _text(name, False)
    used = [t for t in TABLES if re.search(rf"\bfrom {t}\b", text)]
    return spark.sql(re.sub(rf"\bfrom ({'|'.join(used)})\b", r"from {\1}", text), **{t: table(spark, sf_dir, t) for t in used})


def ctes(*names: str) -> str:
    return "with " + ",\n".join(f"{n} as materialized ({_text(n, True)})" for n in names)


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over views, tables and frames named in braces."""
    return spark.sql(text, **{n: spark_view(spark, sf_dir, n) for n in names}, **frames)
