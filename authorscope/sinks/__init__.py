"""Report tables and report documents."""
