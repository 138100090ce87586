"""A deterministic ZIP of a package described by a flat manifest. Runs on the driver."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path

from pairgraph.plans.config import parse_flat_yaml

IMAGE = re.compile(r"[a-z0-9][a-z0-9./_:-]*(@sha256:[0-9a-f]{64})?")
EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")


def check_manifest(text: str, machines: tuple[str, ...]) -> dict[str, str]:
    """The keys image, contact and machine_type with plausible values; <...> stands for one that isn't known yet."""
    values = parse_flat_yaml(text, {"image", "contact", "machine_type"})
    for key, pattern in (("image", IMAGE), ("contact", EMAIL)):
        if not (pattern.fullmatch(values[key]) or re.fullmatch(r"<[^<>]+>", values[key])):
            raise ValueError(f"bad {key}: {values[key]!r}")
    if values["machine_type"] not in machines:
        raise ValueError(f"machine_type must be one of {machines}")
    return values


def write_zip(files: dict[str, bytes], path: str | Path) -> Path:
    """Entries by name with a fixed time and mode, so equal files give equal bytes; read back before returning."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            entry.external_attr, entry.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(entry, files[name])
    with zipfile.ZipFile(target) as z:
        if z.namelist() != sorted(files) or any(z.read(n) != files[n] for n in files):
            raise ValueError("the archive doesn't hold what was written")
    return target
