"""What the library knows about log tables: names and order."""

from __future__ import annotations

# Table names, their copy order and their special columns.
CORE_TABLES = ["version", "user", "world", "block"]
NEVER_COPIED = "database_lock"
COPY_ORDER = [
    "world", "user", "material_map", "blockdata_map", "art_map", "entity_map", "version",
    "username_log", "skull", "entity", "entity_spawn", "block", "container", "item", "sign", "chat", "command",
    "session", "entity_container", "entity_interaction",
]
REFERENCED_TABLES = {"block", "entity", "skull", "entity_spawn"}
NULLABLE_LOCATION = {"wid", "x", "z"}
LOOKUP_KEY_PREFIX = "_key_"


def is_reference(table: str) -> bool:
    return table.endswith("_map") or table in {"user", "world", "version"}


def copy_order(tables) -> list[str]:
    """Reference data first, then history in a fixed order, unknown tables last by name."""
    place = {name: at for at, name in enumerate(COPY_ORDER)}
    return sorted(tables, key=lambda name: (place.get(name, len(COPY_ORDER)), name))
