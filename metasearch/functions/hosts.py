"""Checks of remote hosts and artifacts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from metasearch.functions import paths

#: Machine names by the architecture they mean; others stand for themselves.
ARCHITECTURES = {"x86_64": "x86_64", "amd64": "x86_64", "x64": "x86_64", "aarch64": "aarch64", "arm64": "aarch64"}
#: A user, then a name or a bracketed IPv6 address; neither starts like an option.
HOST = r"^([A-Za-z0-9._][A-Za-z0-9._-]*@)?([A-Za-z0-9._][A-Za-z0-9._-]*|\[(?=[^\]]*:)[0-9A-Fa-f:.]+\])\z"
#: Phrases of errors that mean the host is away, not broken.
OFFLINE = [
    "connection timed out", "connection refused", "no route to host", "network is unreachable", "could not resolve hostname",
    "name or service not known", "operation timed out",
]


def architecture(machine: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ARCHITECTURES.items() for x in pair])
    name = paths.ascii_lower(F.trim(machine))
    return F.coalesce(F.try_element_at(table, name), name)


def artifact_name(prefix: str, system: str, machine: str) -> str:
    name = machine.strip().lower()
    return f"{prefix}-{system}-{ARCHITECTURES.get(name, name)}{'.exe' if system == 'windows' else ''}"


def valid_host(host: Column) -> Column:
    return host.rlike(HOST)


def valid_host_text(host: str) -> bool:
    return re.match(HOST.replace(r"\z", r"\Z"), host) is not None


def artifact_matches(data: Column, sha256: Column) -> Column:
    """The checksum file's first word is the data's SHA-256."""
    return F.sha2(data, 256) == F.lower(F.regexp_extract(sha256, r"^\s*([0-9A-Fa-f]{64})(\s|\z)", 1))


def is_offline(message: Column) -> Column:
    return F.exists(F.array(*map(F.lit, OFFLINE)), lambda x: F.contains(F.lower(message), x))
