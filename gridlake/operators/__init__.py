"""DataFrame operators: zones, time, statistics, neighbourhoods, patches."""
