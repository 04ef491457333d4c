"""HTML of Markdown documents."""
