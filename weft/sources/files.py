"""Small files on the driver: written whole or not at all."""

from __future__ import annotations

import os
import tempfile


def write_whole(path: str, data: bytes | str) -> None:
    """Replace a file by new contents that only its owner may read; readers see the old ones or the new ones."""
    raw = data.encode() if isinstance(data, str) else data
    handle, made = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".weft-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(made, 0o600)
        os.replace(made, path)
    except BaseException:
        os.unlink(made)
        raise
