"""Entry-level transforms, layout conversions, graph preparation, generators."""
