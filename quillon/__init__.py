"""Part of the quillon safety-signal analytics engine."""
