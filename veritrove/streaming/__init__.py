"""Row rules over streams."""
