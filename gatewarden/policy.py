"""Policies and their rules: immutable, validated when they are made, read from dictionaries or files."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

MODES = ("allow", "block", "raise")
MATCHES = ("substring", "whole_word", "regexp")
NAME = re.compile(r"[a-z][a-z0-9_.:-]*\Z", re.I)
NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*]")


class ConfigurationError(ValueError):
    """A policy, rule or file that can't be used."""


def require(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigurationError(what)


@dataclass(frozen=True)
class Pattern:
    """A regular expression in the dialect that Java and Python share."""

    source: str
    ignore_case: bool = True

    def __post_init__(self):
        require(isinstance(self.source, str) and self.source != "", "a pattern must be a non-empty string")
        require(not NESTED.search(self.source), "a pattern must not nest repetitions: nothing bounds its time here")
        try:
            compiled = re.compile(self.source)
        except re.error as e:
            raise ConfigurationError(f"invalid pattern: {e}") from e
        require(compiled.match("") is None and compiled.search("") is None, "a pattern must not match an empty string")

    @property
    def java(self) -> str:
        return f"(?iu)(?:{self.source})" if self.ignore_case else f"(?:{self.source})"

    @property
    def python(self) -> re.Pattern:
        return re.compile(self.source, re.I if self.ignore_case else 0)


def term(text: str, match: str) -> Pattern:
    require(isinstance(text, str) and text.strip() != "", "terms must be non-empty strings")
    if match == "regexp":
        return Pattern(text)
    literal = re.escape(text)
    return Pattern(literal if match == "substring" else rf"(?<![^\W_])(?<!_){literal}(?![^\W_])(?!_)")


@dataclass(frozen=True)
class PolicyRule:
    """A named rule: patterns first, then terms under a match mode; what it finds is replaced, and blocked if block is set."""

    name: str
    patterns: tuple = ()
    terms: tuple = ()
    match: str = "whole_word"
    block: bool = True
    description: str | None = None
    replacement: str | None = None
    compiled: tuple[Pattern, ...] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        require(isinstance(self.name, str) and bool(NAME.match(self.name)) and len(self.name) <= 100, "rule name must start with a letter and hold letters, digits and _.:- only")
        for what in ("patterns", "terms"):
            require(isinstance(getattr(self, what), (list, tuple)), f"{what} must be a list")
            object.__setattr__(self, what, tuple(getattr(self, what)))
        require(bool(self.patterns or self.terms), "a rule needs a pattern or a term")
        require(self.match in MATCHES, f"match must be one of {', '.join(MATCHES)}")
        require(isinstance(self.block, bool), "block must be true or false")
        text = self.description
        require(text is None or isinstance(text, str) and text.strip() != "" and len(text) <= 500, "description must have 1 to 500 characters")
        text = self.replacement
        require(text is None or isinstance(text, str) and text.strip() != "" and len(text) <= 100 and not re.search(r"[\r\n\t]", text), "replacement must have 1 to 100 characters on one line")
        if text is None:
            object.__setattr__(self, "replacement", f"[RESTRICTED:{self.name.upper()}]")
        made = [p if isinstance(p, Pattern) else Pattern(p) for p in self.patterns] + [term(t, self.match) for t in self.terms]
        object.__setattr__(self, "compiled", tuple(made))

    @classmethod
    def from_dict(cls, data: Mapping) -> PolicyRule:
        return cls(**_options(cls, data, "rule"))


@dataclass(frozen=True)
class Policy:
    """What is detected, what blocks, and how long a text may be."""

    name: str = "default"
    max_input_length: int = 10_000
    block_pii: bool = False
    block_injections: bool = True
    block_secrets: bool = False
    llm_failure_mode: str = "allow"
    secret_patterns: tuple = ()
    rules: tuple = ()

    def __post_init__(self):
        require(isinstance(self.name, str) and self.name.strip() != "" and len(self.name) <= 100, "policy name must have 1 to 100 characters")
        require(isinstance(self.max_input_length, int) and not isinstance(self.max_input_length, bool) and self.max_input_length >= 0, "max_input_length must be an integer of 0 or more")
        for flag in ("block_pii", "block_injections", "block_secrets"):
            require(isinstance(getattr(self, flag), bool), f"{flag} must be true or false")
        mode = self.llm_failure_mode
        require(isinstance(mode, str) and mode in MODES, f"llm_failure_mode must be one of {', '.join(MODES)}")
        require(isinstance(self.secret_patterns, (list, tuple)) and all(isinstance(p, str) for p in self.secret_patterns), "secret_patterns must be a list of strings")
        object.__setattr__(self, "secret_patterns", tuple(Pattern(p) for p in self.secret_patterns))
        require(isinstance(self.rules, (list, tuple)), "rules must be a list")
        rules = tuple(r if isinstance(r, PolicyRule) else PolicyRule.from_dict(r) for r in self.rules)
        names = [r.name.lower() for r in rules]
        require(len(set(names)) == len(names), "rule names must be unique")
        object.__setattr__(self, "rules", rules)

    @classmethod
    def from_dict(cls, data: Mapping) -> Policy:
        return cls(**_options(cls, data, "policy"))


def _options(cls, data, what: str) -> dict:
    require(isinstance(data, Mapping), f"a {what} must be a mapping")
    known = {f.name for f in fields(cls) if f.init}
    unknown = [k for k in data if str(k) not in known]
    require(not unknown, f"unknown {what} option: {unknown[:1]}")
    return {str(k): v for k, v in data.items()}


def load_policy_file(path: str, environment: str = "production") -> Policy:
    """A policy from a JSON or YAML file: a document of policy options, or one keyed by environment. Aliases and tags are refused."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError as e:
        raise ConfigurationError(f"policy file is missing: {path}") from e
    except OSError as e:
        raise ConfigurationError(f"policy file can't be read: {path}") from e
    data = _parse(text, path)
    require(isinstance(data, Mapping), f"policy file must hold a mapping: {path}")
    known = {f.name for f in fields(Policy)}
    if not known & {str(k) for k in data}:
        require(environment in data, f"policy file has no section for {environment}: {path}")
        data = data[environment]
    try:
        return Policy.from_dict(data)
    except ConfigurationError as e:
        raise ConfigurationError(f"invalid policy in {path}: {e}") from e


def _parse(text: str, path: str):
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise ConfigurationError(f"policy file isn't JSON, and no YAML parser is installed: {path}") from e

    class Loader(yaml.SafeLoader):
        def compose_node(self, parent, index):
            if self.check_event(yaml.events.AliasEvent):
                raise ConfigurationError(f"policy file must not use aliases: {path}")
            return super().compose_node(parent, index)

    try:
        return yaml.load(text, Loader)
    except yaml.YAMLError as e:
        raise ConfigurationError(f"policy file isn't safe YAML: {path}") from e


def write_policy_template(path: str) -> str:
    """A JSON policy file with a section for each of three environments, to be edited. A file that is there already is kept, and an error raised."""
    section = {"name": "default", "max_input_length": 10_000, "block_pii": False, "block_injections": True, "block_secrets": False, "llm_failure_mode": "allow", "secret_patterns": [], "rules": []}
    sample = {"name": "restricted_project", "terms": ["Example Project"], "match": "whole_word", "block": True, "description": "Names of unreleased projects", "replacement": "[PROJECT]"}
    data = {
        "development": section | {"name": "development"},
        "test": section | {"name": "test"},
        "production": section | {"name": "production", "block_secrets": True, "llm_failure_mode": "block", "rules": [sample]},
    }
    try:
        with open(path, "x", encoding="utf-8") as f:
            json.dump(data, f, indent=2)
    except FileExistsError as e:
        raise ConfigurationError(f"policy file is there already: {path}") from e
    return path
