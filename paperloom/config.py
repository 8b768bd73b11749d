"""Options of a conversion."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """What a conversion does."""

    remove_artifacts: bool = True
    extract_images: bool = True
    extract_tables: bool = False
    use_llm: bool = False
    llm_provider: str = "ollama"
    llm_model: str | None = None
    llm_api_key: str | None = None
    llm_host: str | None = None
    min_repetition: int = 2
    fix_lost_letters: bool = True
    fix_misread_words: bool = True
