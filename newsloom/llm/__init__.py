"""Training-corpus operators; nothing outside this subpackage imports it."""
