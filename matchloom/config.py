"""Settings of a matching run: one table of what may be set, and a reader of YAML files that holds them to it."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from types import MappingProxyType
from typing import Any, NamedTuple


class Setting(NamedTuple):
    kind: type | tuple[type, ...]
    default: Any = None
    #: Values that the engine has something for; anything of the kind if empty.
    allowed: tuple = ()
    required: bool = False


_PATH = Setting(str, required=True)
#: Every setting under its section and name.
SETTINGS: Mapping[str, Setting] = MappingProxyType({
    "dataset.name": _PATH,
    **{f"dataset.{t}": _PATH for t in ("table_a", "table_b", "train", "valid", "test")},
    "dataset.id_col": Setting(str, "id"),
    "dataset.text_col": Setting(str, "title"),
    # the columns that hold maker and price, in this order
    "dataset.structured_cols": Setting(list, ("manufacturer", "price")),
    # where each table comes from: {table_a: {from: path or address, sha256: digest}, ...}
    "dataset.sources": Setting(dict, MappingProxyType({})),
    "blocking.method": Setting(str, "tfidf_cosine", ("tfidf_cosine",)),
    "blocking.threshold": Setting((int, float), 0.1),
    # both names stand for boosted trees, grown by MLlib
    "model.type": Setting(str, "gbt", ("gbt", "lightgbm")),
    "model.params": Setting(dict, MappingProxyType({})),
    "model.early_stopping_rounds": Setting(int, 50),
    "pipeline.random_seed": Setting(int, 42),
    "pipeline.embedding_model": Setting(str, "hashed-trigrams"),
    "pipeline.output_dir": Setting(str, "results"),
    "pipeline.artifacts_dir": Setting(str, "artifacts"),
})
#: What ``model.params`` may hold; 2 ** depth leaves make up for ``num_leaves``.
PARAMS: Mapping[str, Setting] = MappingProxyType({
    "n_estimators": Setting(int, 1000), "learning_rate": Setting((int, float), 0.05), "num_leaves": Setting(int, 31), "scale_pos_weight": Setting((int, float, type(None)), None),
})


def _checked(name: str, value: Any, setting: Setting) -> Any:
    if isinstance(value, bool) or not isinstance(value, setting.kind):
        raise TypeError(f"{name}: {value!r} is not of the kind expected")
    if setting.allowed and value not in setting.allowed:
        raise ValueError(f"{name}: {value!r}, where only {', '.join(setting.allowed)} can be done")
    return value


def settings_of(raw: Mapping[str, Mapping[str, Any] | None]) -> dict[str, Any]:
    """All settings by dotted name, defaults filled in.

    ``KeyError`` for a required one that is missing, ``TypeError`` for one that does not exist or is of another kind,
    ``ValueError`` for a value that nothing here can serve.
    """
    given = {f"{section}.{name}": value for section, part in raw.items() for name, value in (part or {}).items()}
    if unknown := sorted(given.keys() - SETTINGS.keys()):
        raise TypeError(f"no such setting: {', '.join(unknown)}")
    if missing := [n for n, s in SETTINGS.items() if s.required and n not in given]:
        raise KeyError(f"not set: {', '.join(missing)}")
    out = {n: _checked(n, given[n], s) if n in given else s.default for n, s in SETTINGS.items()}
    params = out["model.params"]
    if unknown := sorted(set(params) - PARAMS.keys()):
        raise TypeError(f"no such setting: {', '.join(f'model.params.{u}' for u in unknown)}")
    out["model.params"] = {n: _checked(f"model.params.{n}", params[n], s) if n in params else s.default for n, s in PARAMS.items()}
    if len(out["dataset.structured_cols"]) != 2:
        raise ValueError("dataset.structured_cols: two columns are needed, maker and price")
    return out


def load_config(path: str | Path) -> dict[str, Any]:
    """The settings of a YAML file (see ``settings_of``); ``FileNotFoundError`` if there is none."""
    import yaml

    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no such settings file: {path}")
    return settings_of(yaml.safe_load(path.read_text()) or {})
