"""Settings with their defaults and limits; an unknown choice or a number out of range is put right on reading and writing.

Stored settings are texts by name: flags are "1" and "0", an empty text is the same as none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

#: Fixed limits: least and most.
LIMITS = {"max_pages": (1, 2000), "chunk_size": (1000, 30000), "ocr_long_side": (1000, 5000)}
#: Fixed choices, for each of these settings.
ENGINES = ("gemini", "nvidia")
CHOICES = {"ocr_engine": ENGINES, "markup_engine": ENGINES, "fix_engine": ENGINES, "pdf_text_mode": ("auto", "ocr"), "workflow": ("legacy", "strict")}
#: Fixed address that is no longer answered and is read as the default.
RETIRED_ENDPOINT = "https://ai.api.nvidia.com/v1/gr/meta/nemotron-parse-1.1"


@dataclass(frozen=True)
class Settings:
    max_pages: int = 20
    chunk_size: int = 5000
    ocr_long_side: int = 2600
    strict: bool = True
    ocr_key: str = ""
    vision_key: str = ""
    endpoint: str = "https://integrate.api.nvidia.com/v1/chat/completions"
    ocr_model: str = "nvidia/nemotron-parse"
    vision_ocr_model: str = "gemini-flash-latest"
    vision_markup_model: str = "gemini-flash-latest"
    ocr_engine: str = "nvidia"
    markup_engine: str = "gemini"
    markup_model: str = "meta/llama-3.3-70b-instruct"
    fix_engine: str = "nvidia"
    fix_model: str = "z-ai/glm-5.2"
    pdf_text_mode: str = "auto"
    workflow: str = "legacy"
    fix_typos: bool = True
    compare_ocr: bool = False
    refine_tables: bool = False

    @classmethod
    def read(cls, values: dict) -> Settings:
        """From stored texts.  A model that both vision steps once shared (``vision_model``) stands in for either."""
        shared = values.get("vision_model")
        found = {}
        for f in fields(cls):
            raw = values.get(f.name, shared or f.default if f.name.startswith("vision_") and f.name.endswith("_model") else f.default)
            if isinstance(f.default, bool):
                raw = raw if isinstance(raw, bool) else {"1": True, "true": True, "0": False, "false": False}.get(raw, f.default)
            elif f.name in LIMITS:
                raw = _whole(raw, f.default, *LIMITS[f.name])
            elif f.name in CHOICES:
                raw = raw if raw in CHOICES[f.name] else f.default
            elif raw == RETIRED_ENDPOINT:
                raw = f.default
            found[f.name] = raw
        return cls(**found)

    def stored(self) -> dict[str, str]:
        """Texts to store, put right as on reading; what is empty is left out, where there is a default that is stored."""
        ready = Settings.read({f.name: getattr(self, f.name) for f in fields(self)})
        out = {}
        for f in fields(self):
            value = getattr(ready, f.name)
            text = str(int(value)) if isinstance(value, bool) else str(value).strip() or f.default
            if text:
                out[f.name] = str(text)
        return out


def _whole(raw, default: int, low: int, high: int) -> int:
    """The whole number that a text begins with, within limits."""
    m = re.match(r"\s*([+-]?\d+)", str(raw))
    return min(high, max(low, int(m[1]))) if m else default
