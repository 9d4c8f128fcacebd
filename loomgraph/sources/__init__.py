"""Sources: Parquet tables, git repositories, manifests and configurations."""
