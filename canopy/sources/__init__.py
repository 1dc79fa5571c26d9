"""Where trees come from: tables, pages, source files."""
