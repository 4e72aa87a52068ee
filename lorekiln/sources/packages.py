"""YAML packages: a row for each file, read and written without the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def yaml_documents(spark: SparkSession, root: str, glob: str = "*.{yaml,yml}") -> DataFrame:
    """(path, content, fault) of the YAML files below root: content a VARIANT, null with the fault where a file is none or holds no mapping or list.

    Spark lists and reads the files, so they may be in any store; each is parsed in the task that read it. Dates become text. Needs PyYAML on the workers.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    texts = files.select(F.col("_metadata.file_path").alias("path"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            found = []
            for text in pdf["value"]:
                try:
                    loaded = yaml.safe_load(text)
                    found.append((json.dumps(loaded, default=str, ensure_ascii=False), None) if isinstance(loaded, dict | list) else (None, "no mapping or list"))
                except yaml.YAMLError as e:
                    found.append((None, str(e).splitlines()[0]))
            yield pd.DataFrame({"path": pdf["path"], "json": [a for a, _ in found], "fault": [b for _, b in found]})

    return texts.mapInPandas(parse, "path string, json string, fault string").select("path", F.try_parse_json("json").alias("content"), "fault")


def entries(documents: DataFrame, at: str = "$") -> DataFrame:
    """(path, key, value VARIANT) of the mapping that each document holds at a place."""
    spark = documents.sparkSession
    return spark.sql(f"SELECT path, e.key, e.value FROM {{d}}, LATERAL variant_explode(try_variant_get(content, '{at}', 'variant')) e", d=documents)


def rule_table(documents: DataFrame, axes: dict[str, str | None], named: str = "keywords") -> DataFrame:
    """rules(axis, value, keyword, ord) of packages whose mapping of each axis names rules with lists of keywords; axes gives the field that holds a rule's value, None: its name.

    ord is the place of the rule in its mapping's names. Rules without keywords or value give no rows.
    """
    out = None
    for axis, field in axes.items():
        rules = entries(documents, f"$.{axis}")
        value = F.col("key") if field is None else F.expr(f"try_variant_get(value, '$.{field}', 'string')")
        words = F.expr(f"try_variant_get(value, '$.{named}', 'array<string>')")
        one = rules.select(F.lit(axis).alias("axis"), value.alias("value"), F.explode(words).alias("keyword"), F.xxhash64("key").alias("ord")).where("value IS NOT NULL AND keyword IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out


def write_yaml(rows: DataFrame, root: str, name: str = "name", content: str = "content") -> None:
    """A YAML file in a folder of its own for each row of rows(name, content), content being JSON text; a folder that exists is replaced, others stay."""

    def dump(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            yield pd.DataFrame({name: pdf[name], "value": [yaml.safe_dump(json.loads(c), allow_unicode=True, sort_keys=False) for c in pdf[content]]})

    texts = rows.select(name, content).mapInPandas(dump, f"{name} string, value string")
    texts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).text(root)
