"""SVG pictures of small, aggregated tables."""
