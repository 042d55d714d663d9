"""Thresholds of validation; their values become literals of the plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ValidationConfig:
    # The published defaults of the rules.
    min_usable_text_chars: int = 80
    min_pdf_character_objects: int = 20
    scanned_image_coverage_threshold: float = 0.80
    mixed_image_coverage_threshold: float = 0.20
    token_coverage_review_threshold: float = 0.85
    token_coverage_fail_threshold: float = 0.60
    char_ratio_review_threshold: float = 0.70
    empty_docling_reference_chars: int = 100
    max_replacement_char_ratio: float = 0.005
    check_tables: bool = True
    max_critical_page_fraction: float = 0.20
    minimum_critical_pages_for_document_failure: int = 2
