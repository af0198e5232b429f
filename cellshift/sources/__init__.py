"""File catalogs, manifests, registries and sinks."""
