"""Settings: fixed defaults, some of which the environment may override."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default, kind):
    """The environment's value, or the default where it is unset, empty or not of the kind."""
    text = os.environ.get(f"CARDLOOM_{name}", "").strip()
    try:
        return kind(text) if text else default
    except ValueError:
        return default


def _from_env(name: str, default, kind):
    return field(default_factory=lambda: _env(name, default, kind))


@dataclass(frozen=True)
class Settings:
    card_conf: float = _from_env("CARD_CONF", 0.25, float)
    card_conf_warn: float = 0.45
    field_conf: float = _from_env("FIELD_CONF", 0.20, float)
    digit_conf: float = _from_env("DIGIT_CONF", 0.25, float)
    digit_iou: float = 0.40
    min_card_height: int = 120
    min_card_width: int = 200
    low_confidence: float = 0.40
    fuzzy: bool = False
    fuzzy_threshold: float = 92.0
    max_upload_mb: int = _from_env("MAX_UPLOAD_MB", 10, int)
    ocr_engines: tuple[str, ...] = field(default_factory=lambda: tuple(x.strip() for x in _env("OCR_ENGINES", "easyocr,paddleocr", str).split(",") if x.strip()))
    canvas_width: int = 1000
    canvas_height: int = 630

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb * 1024 * 1024
