"""Generic DataFrame operators; none of them knows a banking table."""
