"""Cleaning options and configuration files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

from .errors import ConfigError


@dataclass(frozen=True)
class CleanConfig:
    """What the cleaner does; patterns are literal and matched without regard to case, after white space is normalised."""

    clean_html: bool = True
    clean_numbers_percentages: bool = True
    normalize_unicode: bool = True
    fix_encoding: bool = True
    normalize_whitespace: bool = True
    remove_extra_punctuation: bool = True
    standardize_quotes: bool = True
    tokenize: bool = False
    stem: bool = False
    header_patterns: tuple = field(default=())
    footer_patterns: tuple = field(default=())

    @staticmethod
    def of(options: dict | CleanConfig | None) -> CleanConfig:
        """From a mapping; ``remove_headers`` and ``remove_footers`` stand in for pattern lists that are empty."""
        if isinstance(options, CleanConfig):
            return options
        options = dict(options or {})
        for alias, name in (("remove_headers", "header_patterns"), ("remove_footers", "footer_patterns")):
            given = options.pop(alias, None)
            if given and not options.get(name):
                options[name] = given
        names = {f.name for f in fields(CleanConfig)}
        if unknown := sorted(set(options) - names):
            raise ConfigError(f"unknown cleaning options: {', '.join(unknown)}")
        for name in ("header_patterns", "footer_patterns"):
            options[name] = tuple(options.get(name) or ())
        made = CleanConfig(**options)
        return replace(made, tokenize=True) if made.stem else made


def load_yaml(path: str = "params.yaml") -> dict:
    """A YAML file as a mapping. Missing: FileNotFoundError; malformed: ConfigError."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no configuration file {path}")
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            return yaml.safe_load(f) or {}
        except yaml.YAMLError as e:
            raise ConfigError(f"{path} isn't valid YAML: {e}") from e


def package_path(name: str = "") -> str:
    """Path of a file of the package."""
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), name)


def default_params_path() -> str:
    return os.path.join(os.getcwd(), "params.yaml")
