"""Reports as lines of Markdown or as JSON, and the entities of an export with their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exports import write_csv, write_json_lines

#: The entities of an export, each with its table and the order of its rows.
ENTITIES = {
    "run": ("crawl_run", ["started_at", "run_id"]),
    "partition": ("partition", ["data_ini", "id"]),
    "case": ("case_record", ["id_origem"]),
    "subject": ("subject", ["id_origem", "nivel"]),
    "party": ("party", ["id_origem", "polo", "ordem"]),
    "lawyer": ("lawyer", ["id_origem", "polo", "ordem"]),
    "movement": ("movement", ["id_origem", "seq"]),
    "document": ("document", ["id_origem", "id_doc"]),
    "blob": ("blob", ["id_origem", "key"]),
}


def markdown(title: str, rows: DataFrame, order: list[str]) -> DataFrame:
    """(place, line) of a report with one table. rows are a summary: their order gives each line its place."""
    spark = rows.sparkSession
    head = ["# " + title, "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + len(head) - 1).cast("bigint").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |")).alias("line"))
    return spark.createDataFrame(list(enumerate(head)), "place bigint, line string").union(body)


def export(tables: dict[str, DataFrame], path: str, form: str = "jsonl") -> list[str]:
    """Writes each entity whose table is given, in its order, under `path`; returns the entities written. Empty tables give a
    header in CSV and no lines in JSON lines."""
    write = {"jsonl": write_json_lines, "csv": write_csv}[form]
    done = []
    for entity, (name, order) in ENTITIES.items():
        if name in tables:
            write(tables[name], f"{path}/{entity}.{form}", order)
            done.append(entity)
    return done
