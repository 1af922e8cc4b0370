"""Settings: the defaults, over them an INI file, over that the environment."""

from __future__ import annotations

import configparser
import os
from collections.abc import Mapping

DEFAULTS = {
    "params": {"debug": "false", "version": "0.2.1"},
    "feeds": {"list": "", "sources": ""},
    "storage": {"local": "", "remote": "", "public": ""},
    "naming": {"provider": "local", "model": "", "url": "", "timeout": "20"},
}


def settings(path: str | None = None, env: Mapping[str, str] | None = None) -> dict[str, dict[str, str]]:
    """Sections of settings. NEWSLOOM_<SECTION>_<KEY> overrides a key; a missing file is an empty one; unknown sections of it are kept."""
    env = os.environ if env is None else env
    ini = configparser.ConfigParser(interpolation=None)
    ini.read_dict(DEFAULTS)
    if path:
        ini.read(path)
    return {s: {k: env.get(f"NEWSLOOM_{s}_{k}".upper(), v) for k, v in ini[s].items()} for s in ini.sections()}


def debug(conf: dict[str, dict[str, str]]) -> bool:
    return conf["params"]["debug"].lower() == "true"
