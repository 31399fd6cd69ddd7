"""Identity of a run and the checks before it starts."""

from __future__ import annotations

import datetime
import os
import random
import re
import socket
import subprocess
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.fixed import RELATIONS, SLOTS, SPLITS


class RunError(ValueError):
    """A run that must not start or go on."""


@dataclass(frozen=True)
class Slice:
    """What must agree for a ledger to be continued (code_version is only told)."""

    run_id: str
    task_family: str
    model_id: str
    prompt_id: str
    split: str
    dataset_sha256: str
    config_fingerprint: str
    milestone: str = ""
    dataset_path: str = ""
    prompt_version: str = ""
    scoring_version: str = ""
    code_version: str = ""


def slug(text: str) -> str:
    out = re.sub(r"[^a-z0-9]+", "-", text.strip().lower()).strip("-")
    if not out:
        raise RunError(f"nothing left of {text!r}")
    return out


def run_stem(*parts: str) -> str:
    return "__".join(map(slug, parts))


def utc_now() -> str:
    return datetime.datetime.now(datetime.UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")


def check_relations(listed: dict[str, dict]) -> None:
    """The whitelist names the frozen relations with their coarse types; further keys of an entry are ignored."""
    got = {k: (v.get("relation_name"), v.get("coarse_type")) for k, v in listed.items()}
    want = {k: v[:2] for k, v in RELATIONS.items()}
    if got != want:
        raise RunError(f"relations differ from the frozen ones: {sorted(k for k in got.keys() | want.keys() if got.get(k) != want.get(k))}")


def check_slots(listed: list[str]) -> None:
    """V05."""
    if set(listed) != set(SLOTS):
        raise RunError(f"slots differ from the frozen ones: {sorted(set(listed) ^ set(SLOTS))}")


def check_targets(targets: dict[str, int]) -> None:
    """A positive whole number for every split, and no other."""
    if set(targets) != set(SPLITS) or any(not isinstance(n, int) or isinstance(n, bool) or n <= 0 for n in targets.values()):
        raise RunError(f"targets must be positive for {', '.join(SPLITS)}: {targets}")


def code_version(folder: str = ".") -> str:
    """The commit that runs, or a marker where there is none."""
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, check=True, capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return "not_a_git_repo"
    return done.stdout.strip()


def attempt_id() -> str:
    """Time, host, process and a random end."""
    now = datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ")
    return f"{now}__{socket.gethostname()}__pid{os.getpid()}__{random.getrandbits(24):06x}"


def dataset_path(task_family: str, split: str, root: str = "data/processed") -> str:
    """X21."""
    folders = {"qa_key": "qakey", "biorubric": "biorubric"}
    if task_family not in folders:
        raise RunError(f"unknown task {task_family!r}")
    return f"{root}/{folders[task_family]}/{split}_families.jsonl"


def queue_digest(families: DataFrame, order_col: str = "ordinal", id_col: str = "family_id") -> dict:
    """Number of queued ids, and a digest of which id stands at which place: another order is another digest.

    Every row hashes its place with its id, and sums and exclusive ors of the hashes do not depend on
    where rows are; two numbers of 64 bits go to the driver. Without order_col ids have no places.
    """
    row = [F.col(order_col) if order_col in families.columns else F.lit(None).cast("long"), F.col(id_col)]
    one, two = F.xxhash64(*row), F.xxhash64(*row, F.lit(1))
    r = families.agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"), F.sum(F.pmod(one, F.lit(1 << 31))).alias("s")).first()
    return {"n": r["n"], "digest": f"{(r['x'] or 0) & (1 << 64) - 1:016x}{(r['y'] or 0) & (1 << 64) - 1:016x}{r['s'] or 0:x}"}


def manifest(spec: Slice, families: DataFrame) -> dict:
    return asdict(spec) | {"queue": queue_digest(families)}


def check_resume(saved: dict, spec: Slice, families: DataFrame) -> None:
    """Identity, number of families and their ids in the order of the queue must agree with the ledger's manifest."""
    now = manifest(spec, families)
    if differs := sorted(k for k in now if k != "code_version" and saved.get(k) != now[k]):
        raise RunError(f"the ledger belongs to another run: {', '.join(differs)} differ")


def status(run: dict, counts: dict, ledger: str) -> dict:
    """A snapshot of one run: its identity, its state and how many families are where."""
    keys = ("run_id", "state", "phase", "task_family", "split", "model_id", "prompt_id", "dataset_sha256")
    return {k: run.get(k) for k in keys} | {"total_families": run.get("queue", {}).get("n")} | counts | {"ledger": ledger}


def matrix_status(runs: list[dict]) -> dict:
    """All slices of a matrix: how many are in each state, and families completed of all."""
    states: dict[str, int] = {}
    for r in runs:
        key = r.get("state") or "MISSING"
        states[key] = states.get(key, 0) + 1
    total, done = (sum(r.get(k) or 0 for r in runs) for k in ("total_families", "complete"))
    return {"n_slices": len(runs), "states": dict(sorted(states.items())), "total_families": total, "completed_families": done}
