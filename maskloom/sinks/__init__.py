"""Writers of exchange formats and frozen training snapshots."""
