"""A pre-commit hook that refreshes the index; installing it twice changes nothing."""

from __future__ import annotations

import os
import stat

MARK = "# quarry: refresh the index"


def install(root: str, command: str = "python -m quarry index . --quiet") -> bool:
    """Create the hook or append to it; False if it is there already. Raises outside a git repository."""
    folder = os.path.join(root, ".git", "hooks")
    if not os.path.isdir(os.path.join(root, ".git")):
        raise FileNotFoundError(f"{root} is no git repository")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "pre-commit")
    text = "#!/bin/sh\n"
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if MARK in text:
            return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{text.rstrip()}\n{MARK}\n{command}\n")
    os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
    return True
