"""Fetching of repositories by a command that the caller may replace."""

from __future__ import annotations

import shutil
import subprocess
import time
from collections.abc import Callable, Sequence
from pathlib import Path

# Options of each try, the plain one first. Certificates are always checked.
TRIES = ((), ("-c", "http.sslVersion=TLSv1.2"), ("-c", "http.lowSpeedLimit=0", "-c", "http.lowSpeedTime=999999"))


def _git(command: Sequence[str], folder: Path | None, timeout: int) -> None:
    subprocess.run(["git", *command], cwd=folder, check=True, timeout=timeout)


def fetch(
    url: str,
    folder: str,
    paths: Sequence[str] = (),
    rounds: int = 3,
    run: Callable[[Sequence[str], Path | None, int], None] = _git,
    wait: Callable[[float], None] = time.sleep,
) -> Path:
    """Clone a repository into a folder under its name and return the place; one that is there already is kept.

    Each round tries all options, and waits 2 ** round seconds after one that fails; what a failed try leaves is removed.
    paths: check out only these. run: (arguments of git, folder, seconds) raises if the command fails.
    """
    place = Path(folder) / Path(url.rstrip("/").rsplit("/", 1)[-1]).stem
    if place.exists():
        return place
    failed: Exception | None = None
    for round_ in range(rounds):
        for options in TRIES:
            try:
                run([*options, "clone", *(["--no-checkout"] if paths else []), url, str(place)], None, 300)
                if paths:
                    run(["sparse-checkout", "init", "--cone"], place, 60)
                    run(["sparse-checkout", "set", *paths], place, 60)
                    run(["checkout"], place, 60)
                return place
            except (subprocess.SubprocessError, OSError) as e:
                failed = e
                shutil.rmtree(place, ignore_errors=True)
                if (round_, options) != (rounds - 1, TRIES[-1]):
                    wait(2**round_)
    raise RuntimeError(f"{url} could not be cloned in {rounds} rounds") from failed
