"""weftline subpackage."""
