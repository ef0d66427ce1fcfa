"""newsloom subpackage."""
