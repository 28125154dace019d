"""Parameters of the jobs, read from an ini file; missing values keep their defaults."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields
from pathlib import Path

from phraseweave.functions.uri import ONTOLOGY


@dataclass(frozen=True)
class Config:
    use_dump: bool = True
    randomize: bool = False
    relation_types_limit: int = 50
    facts_limit: int = 2000
    relation_types: str = "birthPlace"
    replace_redirects: bool = False
    perform_tests: bool = False
    least_threshold_types: float = 1.0
    least_threshold_words: float = 2.0
    type_facts_limit: int = 0
    subject_minimum: float = 0.05
    object_minimum: float = 0.05
    articles_limit: int = 5000
    match_threshold: float = 0.5
    type_matching: bool = True
    allow_unknown_entity_types: bool = True
    test_facts_limit: int = 100
    depth: int = 2
    max_tokens: int = 50
    position_weight: float = 0.15
    syntax_weight: float = 1.0

    @classmethod
    def read(cls, path: str | Path) -> Config:
        """Values by name from any section of the file."""
        parser = configparser.ConfigParser()
        parser.read(path)
        found = {k: v for section in parser.sections() for k, v in parser.items(section)}
        kinds = {"bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[f.type](found[f.name]) for f in fields(cls) if f.name in found})

    def relations(self) -> list[str]:
        """IRIs of the wanted relations; none: all. Blank names and names with a semicolon are left out."""
        names = [n.strip() for n in self.relation_types.split(",")]
        return [ONTOLOGY + n for n in names if n and ";" not in n]
