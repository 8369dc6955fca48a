"""A repository's name to a local folder: the folder itself, or a shallow clone that is kept and brought up to date."""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Callable, Sequence
from pathlib import Path

from pergola.sources.files import SHORT, URL

ERROR_CHARS = 400
TIMEOUT = 300
HOST = "https://github.com"

Run = Callable[[Sequence[str], str | None], str]


class CheckoutError(Exception):
    """A name that is no repository, or a git command that failed, with the end of what it said."""


def git(arguments: Sequence[str], folder: str | None = None, timeout: int = TIMEOUT) -> str:
    """What a git command prints."""
    try:
        done = subprocess.run(["git", *arguments], cwd=folder, capture_output=True, text=True, timeout=timeout, env=None)
    except FileNotFoundError as e:
        raise CheckoutError("git is not installed") from e
    except subprocess.TimeoutExpired as e:
        raise CheckoutError(f"git {arguments[0]} took more than {timeout} s") from e
    if done.returncode:
        raise CheckoutError(f"git {arguments[0]}: {(done.stderr or done.stdout).strip()[:ERROR_CHARS]}")
    return done.stdout.strip()


def folder_name(url: str) -> str:
    """owner-name of an address, in letters, digits, '.', '_' and '-'."""
    parts = re.split(r"[/:]", re.sub(r"\.git$", "", url.rstrip("/")))
    return re.sub(r"[^\w.-]+", "-", "-".join(parts[-2:])).strip("-").lower() or "repo"


def resolve(name: str, cache: str, refresh: bool = False, run: Run = git) -> tuple[str, str]:
    """The folder of a repository and its commit ('' if it has none): an existing folder as it is; owner/name or an address cloned below `cache`.

    A clone that is there already is fetched and reset to the remote's head; with refresh it is removed first.
    """
    local = Path(name).expanduser()
    if local.is_dir():
        try:
            return str(local.resolve()), run(["rev-parse", "HEAD"], str(local))
        except CheckoutError:
            return str(local.resolve()), ""
    bare = re.sub(r"\.git$", "", name)
    if re.match(SHORT, bare):
        url = f"{HOST}/{bare}.git"
    elif re.match(URL, name):
        url = name
    else:
        raise CheckoutError(f"neither a folder nor a repository: {name}")
    where = Path(cache) / folder_name(url)
    if refresh and where.exists():
        shutil.rmtree(where)
    if (where / ".git").is_dir():
        run(["fetch", "--depth", "1", "origin", "HEAD"], str(where))
        run(["reset", "--hard", "FETCH_HEAD"], str(where))
    else:
        where.parent.mkdir(parents=True, exist_ok=True)
        run(["clone", "--depth", "1", url, str(where)], None)
    return str(where), run(["rev-parse", "HEAD"], str(where))
