"""first_pairs inside the JVM: a function of two lists of texts that gives the places of the pairs whose MD5 begins low.

Spark brings its own Java compiler (Janino), which makes one small class from the source below; it goes to the executors as a jar. Each step of MD5 is a loop over 1,024 pairs, which
the JVM turns into vector instructions. Where that can't be set up, `function` gives None and the caller hashes in numpy.
"""

from __future__ import annotations

import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from evgraph.operators.first_pairs import _K, _START, _TURN, _WORD, BLOCK

CLASS, AT_ONCE = "evgraph.FirstPairs", 1024
_MIX = ["(d[i] ^ (b[i] & (c[i] ^ d[i])))", "(c[i] ^ (d[i] & (b[i] ^ c[i])))", "(b[i] ^ c[i] ^ d[i])", "(c[i] ^ (b[i] | ~d[i]))"]
_made: dict[str, object] = {}


def _steps() -> str:
    """One method for each of the four rounds, with and without a word of the message that differs by pair."""
    return "".join(
        f"static void {name}{r}(int[] a, int[] b, int[] c, int[] d, {more}int k, int s) {{ int t = 32 - s; for (int i = 0; i < {AT_ONCE}; i++) {{ int x = a[i] + {mix}{add} + k; a[i] = ((x << s) | (x >>> t)) + b[i]; }} }}\n"
        for r, mix in enumerate(_MIX)
        for name, more, add in (("own", "int[] w, ", " + w[i]"), ("same", "", ""))
    )


def _source() -> str:
    numbers = lambda xs: ", ".join(str(x - (1 << 32) if x >= 1 << 31 else x) for x in xs)
    rounds = "".join(
        f"if (i {'<' if r < 3 else '<='} {16 * r + 16 if r < 3 else 60}) {{ if (w[WORD[i]] != null) own{r}(p, q, u, v, w[WORD[i]], K[i], TURN[i]); else same{r}(p, q, u, v, K[i] + head[WORD[i]], TURN[i]); continue; }}\n" for r in range(4)
    )
    return f"""
package {CLASS.rpartition(".")[0]};
public class FirstPairs implements org.apache.spark.sql.api.java.UDF6, java.io.Serializable {{
    static final int N = {AT_ONCE}, BLOCK = {BLOCK};
    static final int[] K = {{{numbers(_K)}}}, TURN = {{{numbers(_TURN)}}}, WORD = {{{numbers(_WORD)}}}, START = {{{numbers(_START)}}};
    {_steps()}
    static int[] sizes(String text) {{
        if (text.isEmpty()) return new int[0];
        String[] parts = text.split(",");
        int[] out = new int[parts.length];
        for (int i = 0; i < out.length; i++) out[i] = Integer.parseInt(parts[i]);
        return out;
    }}
    static void put(int[] words, byte[] bytes, int from, int n, int at) {{
        for (int i = 0; i < n; i++) words[(at + i) >> 2] |= (bytes[from + i] & 255) << (8 * ((at + i) & 3));
    }}
    static void or(int[] out, int[] x, int y) {{ for (int i = 0; i < N; i++) out[i] = x[i] | y; }}
    /* texts of the sources and targets side by side, their sizes in bytes (-1: missing) with commas, the seed, the bound */
    public Object call(Object left, Object leftSizes, Object right, Object rightSizes, Object seed, Object most) {{
        byte[] lb = (byte[]) left, rb = (byte[]) right, begin = (seed + "|").getBytes();
        int[] ls = sizes((String) leftSizes), rs = sizes((String) rightSizes), starts = new int[rs.length];
        long bound = ((Number) most).longValue();
        for (int j = 1; j < rs.length; j++) starts[j] = starts[j - 1] + Math.max(0, rs[j - 1]);
        long[] found = new long[1024];
        int n = 0, at = 0;
        int[][][][] packed = new int[BLOCK + 2][][][];
        int[][] places = new int[BLOCK + 2][];
        int[][] state = new int[4][N];
        int[] first = new int[N];
        for (int i = 0; i < ls.length; at += Math.max(0, ls[i]), i++) {{
            int size = ls[i] < 0 ? BLOCK + 1 : Math.min(BLOCK + 1, begin.length + ls[i] + 1);
            if (places[size] == null) {{
                int some = 0, wide = 0;
                places[size] = new int[rs.length];
                for (int j = 0; j < rs.length; j++) if (rs[j] >= 0 && size + rs[j] <= BLOCK) {{ places[size][some++] = j; wide = Math.max(wide, size + rs[j]); }}
                places[size] = java.util.Arrays.copyOf(places[size], some);
                int blocks = (some + N - 1) / N;
                packed[size] = new int[blocks][16][];
                for (int block = 0; block < blocks; block++) {{
                    int[][] w = packed[size][block];
                    for (int k = size / 4; k <= wide / 4; k++) w[k] = new int[N];
                    if (w[14] == null) w[14] = new int[N];
                    int[] one = new int[16];
                    for (int x = 0; x < N && block * N + x < some; x++) {{
                        int j = places[size][block * N + x], end = size + rs[j];
                        java.util.Arrays.fill(one, 0);
                        put(one, rb, starts[j], rs[j], size);
                        one[end >> 2] |= 128 << (8 * (end & 3));
                        one[14] = 8 * end;
                        for (int k = 0; k < 16; k++) if (w[k] != null) w[k][x] = one[k];
                    }}
                }}
            }}
            int[] fit = places[size];
            for (int j = 0, k = 0; j < rs.length && fit.length < rs.length; j++) {{
                if (k < fit.length && fit[k] == j) {{ k++; continue; }}
                if (n == found.length) found = java.util.Arrays.copyOf(found, 2 * n);
                found[n++] = ((long) i << 32) | j;
            }}
            if (fit.length == 0) continue;
            int[] head = new int[16];
            put(head, begin, 0, begin.length, 0);
            put(head, lb, at, ls[i], begin.length);
            head[(size - 1) >> 2] |= 124 << (8 * ((size - 1) & 3));
            for (int block = 0; block < packed[size].length; block++) {{
                int[][] w = (int[][]) packed[size][block].clone();
                or(first, w[size / 4], head[size / 4]);
                w[size / 4] = first;
                for (int k = 0; k < 4; k++) java.util.Arrays.fill(state[k], START[k]);
                for (int i0 = 0; i0 < 61; i0++) step(i0, state, w, head);
                int here = Math.min(N, fit.length - block * N);
                int[] end = state[0];
                for (int x = 0; x < here; x++) {{
                    int word = end[x] + START[0];
                    if ((Integer.reverseBytes(word) & 0xffffffffL) <= bound) {{
                        if (n == found.length) found = java.util.Arrays.copyOf(found, 2 * n);
                        found[n++] = ((long) i << 32) | fit[block * N + x];
                    }}
                }}
            }}
        }}
        return java.util.Arrays.copyOf(found, n);
    }}
    static void step(int i, int[][] state, int[][] w, int[] head) {{
        int[] p = state[(64 - i) & 3], q = state[(65 - i) & 3], u = state[(66 - i) & 3], v = state[(67 - i) & 3];
        for (int once = 0; once < 1; once++) {{ {rounds} }}
    }}
}}
"""


def _ready(spark: SparkSession) -> object:
    """The function's object, its class compiled and its jar sent out once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _made:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(_source())
        jar = f"{tempfile.mkdtemp(prefix='first-pairs-')}/first_pairs.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.sc().addJar(jar)
        _made[sc.applicationId] = compiler.getClassLoader().loadClass(CLASS).newInstance()
    return _made[sc.applicationId]


def function(spark: SparkSession) -> str | None:
    """The name under which the session knows the function; None where the JVM can't be reached or doesn't take the class."""
    name = "evgraph_first_pairs"
    try:
        spark._jsparkSession.udf().register(name, _ready(spark), spark._jsparkSession.parseDataType(ArrayType(LongType()).json()))
    except Exception:  # noqa: BLE001 whatever is missing, numpy does the same work
        return None
    return name


def below(name: str, sources: str, targets: str, seed: int, bound: int) -> Column:
    """(source, target) of the pairs of two lists (columns of id and text) that first_pairs.below would return, as an array."""
    args = []
    for c in (sources, targets):
        size = F.transform(c, lambda x: F.coalesce(F.octet_length(x["text"]), F.lit(-1)).cast("string"))
        args += [F.array_join(F.transform(c, lambda x: x["text"]), "").cast("binary"), F.array_join(size, ",")]
    found = F.call_function(name, *args, F.lit(str(seed)), F.lit(bound).cast("long"))
    at = lambda c, i: F.get(F.col(c), i.cast("int"))["id"]
    return F.transform(found, lambda x: F.struct(at(sources, F.shiftright(x, 32)).alias("source"), at(targets, x.bitwiseAND(F.lit((1 << 32) - 1))).alias("target")))
