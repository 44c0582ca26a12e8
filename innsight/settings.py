"""Settings by section, with defaults, kept as a JSON file."""

from __future__ import annotations

import copy
import json
import os

# fixed values
DEFAULTS = {
    "database": {"backup_enabled": True, "backup_interval_days": 7},
    "discovery": {"default_radius": 5000, "default_language": "en", "max_results": 500, "save_automatically": True, "default_sources": ["google_places", "openstreetmap", "booking"]},
    "search": {"default_similarity_threshold": 0.7, "max_results": 100, "sort_by": "relevance"},
    "temporal": {"min_history_days": 365, "verification_interval_days": 30},
    "violations": {"min_risk_score": 3, "high_risk_threshold": 7, "medium_risk_threshold": 3, "enable_auto_detection": True},
    "export": {"default_format": "excel", "default_export_path": "exports", "include_risk_analysis": True, "include_history": True},
    "interface": {"language": "en", "color_scheme": "default"},
    "logging": {"level": "INFO", "max_log_size_mb": 10, "max_log_files": 5},
}


class Settings:
    """get, set and reset values; what a file lacks has its default."""

    def __init__(self, path: str | None = None):
        self.path, self.values = path, copy.deepcopy(DEFAULTS)
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for section, own in json.load(f).items():
                    self.values.setdefault(section, {}).update(own)

    def get(self, section: str, key: str, default=None):
        return self.values.get(section, {}).get(key, default)

    def set(self, section: str, key: str, value) -> None:
        self.values.setdefault(section, {})[key] = value
        self.save()

    def section(self, section: str) -> dict:
        return dict(self.values.get(section, {}))

    def reset(self, section: str | None = None) -> None:
        for s in [section] if section else list(DEFAULTS):
            self.values[s] = copy.deepcopy(DEFAULTS.get(s, {}))
        self.save()

    def save(self) -> None:
        if self.path:
            with open(self.path, "w", encoding="utf-8") as f:
                json.dump(self.values, f, ensure_ascii=False, indent=2)
