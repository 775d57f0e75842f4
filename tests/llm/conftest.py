import sys
from pathlib import Path

for path in (Path(__file__).parent, Path(__file__).parents[1], Path(__file__).parents[2]):
    sys.path.insert(0, str(path))
