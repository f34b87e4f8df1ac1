"""``python -m tonelens.cli [--config params.yaml] [--lexicon FILE] [--test]``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import load_yaml
from .plans.pipeline import TonePipeline
from .sources.readers import LEXICON, demo_corpus


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Scores the tone of economic texts.")
    parser.add_argument("--config", default="params.yaml")
    parser.add_argument("--lexicon", help="YAML or Parquet lexicon; the configuration's models.lexical.lexicon_path by default")
    parser.add_argument("--test", action="store_true", help="two short texts and a small lexicon")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tonelens").getOrCreate()
    if given.test:
        words = [("demo", "positive", "improved", 1), ("demo", "positive", "supported", 2), ("demo", "negative", "weakened", 3), ("demo", "negative", "constrained", 4)]
        pipe = TonePipeline(spark, demo_corpus(spark), spark.createDataFrame(words, LEXICON))
        _, _, scored = pipe.run({"tokenize": True}, ["demo"])
        scored.select("id_text", "demo_sentiment_posneg", "demo_sentiment_allwords").show()
        return 0
    config = load_yaml(given.config)
    source, target, lexical = config["input"], config.get("output") or {}, config["models"]["lexical"]
    pipe = TonePipeline(spark, source["file_path"], given.lexicon or lexical["lexicon_path"], source.get("text_column", "text"), source.get("date_column", "date"), target.get("export_path"))
    pipe.run(config.get("cleaning") or {}, lexical["dictionaries"], lexical.get("aggregation_methods") or ["posneg"], bool(target.get("export_results")))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
