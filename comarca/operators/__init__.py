"""DataFrame operators, grouped by the stage of the study they serve."""
