"""Column functions: hashes, mixed radix numbers and plane geometry."""
