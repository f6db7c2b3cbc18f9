"""Plan helpers: shared scratch tables and iteration."""
