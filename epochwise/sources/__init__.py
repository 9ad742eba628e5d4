"""Table reads, versioned batches and dataset export."""
