"""Summarise a Spark event log written to a scratch folder (stage/task/job times).

Usage: python tools/eventlog.py <eventlog dir or file>
"""
import glob
import json
import os
import sys

import zstandard


def load(path):
    files = [path] if os.path.isfile(path) else sorted(glob.glob(f"{path}/**/events*", recursive=True))
    out = []
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
        out += [json.loads(line) for line in raw.decode().splitlines() if line.strip()]
    return out


def main():
    ev = load(sys.argv[1])
    tasks = {}
    for e in ev:
        if e["Event"] == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            tasks.setdefault(e["Stage ID"], []).append(m.get("Executor Run Time", 0))
    t0 = None
    for e in ev:
        if e["Event"] == "SparkListenerJobStart":
            t0 = t0 or e["Submission Time"]
        if e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            tt = tasks.get(si["Stage ID"], [])
            print(f"stage {si['Stage ID']:4d} tasks {si['Number of Tasks']:4d} wall {si['Completion Time'] - si['Submission Time']:6d} ms"
                  f"  task-sum {sum(tt):6d} ms  max {max(tt) if tt else 0:6d} ms  {si['Stage Name'][:50]}")
        if e["Event"].endswith("SQLExecutionStart"):
            print(f"-- sql {e['executionId']} start +{e['time'] - (t0 or e['time'])} ms")
        if e["Event"].endswith("SQLExecutionEnd"):
            print(f"-- sql {e['executionId']} end   +{e['time'] - (t0 or e['time'])} ms")


if __name__ == "__main__":
    main()
