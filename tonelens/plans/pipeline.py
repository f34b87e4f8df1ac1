"""Load, clean, score and export in one object; every stage is lazy until exported or shown."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..errors import LoadError, ScoreError
from ..operators.clean import clean
from ..operators.score import METHODS, score
from ..sources.readers import load_corpus, load_lexicon, standardized, with_text
from ..sources.sinks import export_cleaned, export_scores

log = logging.getLogger(__name__)


def dictionary_groups(dictionaries: dict | list | None) -> tuple[list, list]:
    """(dictionaries for tokens, dictionaries for stems); a flat list is all for tokens."""
    if isinstance(dictionaries, dict):
        return list(dictionaries.get("unstemmed") or []), list(dictionaries.get("stemmed") or [])
    return list(dictionaries or []), []


class TonePipeline:
    """One corpus through the stages. source: a path or a DataFrame; lexicon: a path or a DataFrame.

    order_by: the key that numbers the rows as ``id_text``; without it the date, and among rows of one date a hash of the
    row, so the same rows have the same numbers in every job.
    """

    def __init__(self, spark: SparkSession, source: str | DataFrame, lexicon: str | DataFrame, text_column: str = "text", date_column: str = "date", export_path: str | None = None, order_by: str | list | None = None, partition_by: str | None = None, id_column: str | None = None):
        self.spark, self.source, self.export_path = spark, source, export_path
        self.text_column, self.date_column = text_column, date_column
        self.order_by, self.partition_by, self.id_column = order_by, partition_by, id_column
        self.lexicon = load_lexicon(spark, lexicon) if isinstance(lexicon, str) else lexicon
        self.raw: DataFrame | None = None
        self.cleaned: DataFrame | None = None
        self.full: DataFrame | None = None

    def load(self) -> DataFrame:
        try:
            if isinstance(self.source, DataFrame):
                self.raw = standardized(self.source, self.text_column, self.date_column)
            else:
                self.raw = load_corpus(self.spark, self.source, self.text_column, self.date_column)
        except Exception as e:
            raise LoadError(f"can't load the corpus: {e}") from e
        if log.isEnabledFor(logging.INFO):  # counting takes a pass
            log.info("loaded %d rows and %d columns", self.raw.count(), len(self.raw.columns))
        return self.raw

    def clean(self, options: dict | CleanConfig | None = None) -> DataFrame:
        if self.raw is None:
            self.load()
        raw, key = self.raw, self.order_by
        if key is None:
            raw, key = raw.withColumn("__tie", F.xxhash64(*[c for c, kind in raw.dtypes if not kind.startswith("map")])), ["date", "__tie"]
        self.cleaned = clean(raw, "text", options, key, self.partition_by).drop("__tie")
        return self.cleaned

    def score(self, dictionaries: dict | list | None, methods: list | tuple = METHODS) -> DataFrame | None:
        """The cleaned rows with text and all scores beside them; None, with a warning, without dictionaries."""
        if self.cleaned is None:
            self.clean({"tokenize": True, "stem": True})
        tokens, stems = dictionary_groups(dictionaries)
        if not tokens and not stems:
            log.warning("no dictionaries given: nothing is scored")
            return None
        out = self.cleaned
        for group, column, suffix in ((tokens, "text_tokens_str", ""), (stems, "text_stems", "_stem")):
            if group and column not in out.columns:
                raise ScoreError(f"scoring {', '.join(group)} needs {column}: set {'stem' if suffix else 'tokenize'} in the cleaning options")
            try:
                out = score(out, self.lexicon, group, methods, column, "text", suffix, id_column=self._id()) if group else out
            except (KeyError, ValueError) as e:
                raise ScoreError(f"can't score: {e}") from e
        # rows without text have null scores, and stand in the combined export only
        self.full = out
        return with_text(out)

    def _id(self) -> str | None:
        """A unique id of the rows, for large lexicons: the one given, or ``id_text`` if it isn't numbered within partitions."""
        return self.id_column or (None if self.partition_by else "id_text")

    def run(self, options: dict | CleanConfig | None, dictionaries: dict | list | None, methods: list | tuple = METHODS, export_results: bool = False) -> tuple:
        """(raw, cleaned, scored); a stage left out gives None. With an export path cleaned is read from its export, and scores are made from that."""
        raw = self.load()
        if options is None:
            log.warning("no cleaning options given: nothing is cleaned or scored")
            return raw, None, None
        cleaned = self.clean(options)
        scored = self.score(dictionaries, methods) if dictionaries else None
        if dictionaries is None:
            log.warning("no dictionaries given: nothing is scored")
        if self.export_path:
            self.cleaned = cleaned = export_cleaned(cleaned, self.export_path)
            if scored is not None:
                scored = self.score(dictionaries, methods)
                if export_results:
                    export_scores(cleaned, scored, self.export_path, self.full)
        return raw, cleaned, scored
