"""Query specification, validation and the choice of a candidate plan."""
