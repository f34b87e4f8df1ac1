"""Tone of economic texts on Spark: load, clean, tokenize, count, score, summarise.

Names are imported when first asked for, so that tasks which need one function don't load all.
"""

from importlib import import_module

__version__ = "0.1.0"
_WHERE = {
    "CleanConfig": "config", "load_yaml": "config", "ConfigError": "errors", "LoadError": "errors", "ScoreError": "errors", "ToneError": "errors",
    "clean": "operators.clean", "TextPreview": "operators.preview", "score": "operators.score", "term_hits": "operators.score",
    "summary": "operators.summary", "TonePipeline": "plans.pipeline", "load_corpus": "sources.readers", "load_lexicon": "sources.readers",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(f"no {name} in {__name__}")
