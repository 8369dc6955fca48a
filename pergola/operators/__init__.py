"""DataFrame-to-DataFrame operators; none of them collects its input."""
