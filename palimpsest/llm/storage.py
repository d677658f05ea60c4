"""Where intermediate tables go: the library's shared folder, which a cluster's session has to name."""

from palimpsest.storage import CLEANUP, materialize, numbered, release, scope, shared_folder

__all__ = ["CLEANUP", "materialize", "numbered", "release", "scope", "shared_folder"]
